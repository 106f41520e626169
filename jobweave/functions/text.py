"""Text functions as columns, Unicode-aware throughout; Python only where Spark has no built-in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]"
# Letters that only accented Vietnamese has, for telling it from English.
VIETNAMESE = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
# Levels and groups of titles with their words; the first that fits decides. < and > stand for a word's bounds.
_LEVELS = [
    ("Intern / Thực tập", "<intern(ship)?>|thực tập"),
    ("Fresher / Junior", "<fresher>|<junior>|<jr>|<entry>"),
    ("Middle", "<mid(dle)?>"),
    ("Senior", "<senior>|<sr>"),
    ("Lead / Principal", "<lead>|<principal>|<staff>|<trưởng nhóm>"),
    ("Manager / Head", "<manager>|<head>|<director>|<chief>|<cto>|<trưởng phòng>|<giám đốc>"),
]
_GROUPS = [
    ("Chức danh Data/AI", r"data|dữ liệu|<ai>|a\.i\.|<ml>|machine learning|học máy|mlops|llm|genai|generative|<bi>|business intelligence|analytics|scientist|<nlp>|computer vision|deep learning|trí tuệ nhân tạo|big data|thống kê|statistic"),
    ("Business Analyst", "business analyst|<ba>|phân tích nghiệp vụ|nghiệp vụ"),
]
NO_LEVEL, NO_GROUP = "Không ghi cấp bậc", "IT chung và khác"


def _bounded(steps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The patterns with Unicode word bounds that Java and RE2 both read."""
    return [(n, p.replace("<", r"(?:^|[^\p{L}\p{N}_])").replace(">", r"(?:$|[^\p{L}\p{N}_])")) for n, p in steps]


SENIORITY, TITLE_GROUPS = _bounded(_LEVELS), _bounded(_GROUPS)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def squeeze(c: Column) -> Column:
    """Stripped, with runs of blanks as one."""
    return strip(F.regexp_replace(c, f"{BLANK}+", " "))


def is_missing(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def title_key(c: Column) -> Column:
    """Title for counting: squeezed, in lower case; null when blank."""
    s = F.lower(squeeze(c))
    return F.when(s != "", s)


def job_text(description: Column, requirements: Column) -> Column:
    """Both texts with an empty line between, or the one there is, or null."""
    d, r = blank_to_null(description), blank_to_null(requirements)
    return F.when(d.isNotNull() & r.isNotNull(), F.concat(strip(d), F.lit("\n\n"), strip(r))).otherwise(strip(F.coalesce(d, r)))


def nfkc(c: Column) -> Column:
    """Compatibility form; Spark has no built-in for it."""

    def form(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(form, "string")(c)


def document_text(*parts: Column) -> Column:
    """The parts, missing ones as empty, joined by line feeds in compatibility form."""
    return nfkc(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))


def slug(c: Column) -> Column:
    """Letters without accents and digits, joined by hyphens."""
    pairs = {"a": "áàảãạăắằẳẵặâấầẩẫậ", "e": "éèẻẽẹêếềểễệ", "i": "íìỉĩị", "o": "óòỏõọôốồổỗộơớờởỡợ", "u": "úùủũụưứừửữự", "y": "ýỳỷỹỵ", "d": "đ"}
    plain = F.translate(F.lower(c), "".join(pairs.values()), "".join(k * len(v) for k, v in pairs.items()))
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def language_of(c: Column) -> Column:
    """vi, mixed or en by the share of Vietnamese letters among all letters; null without letters."""
    low = F.lower(c)
    letters = F.length(F.regexp_replace(low, r"[^\p{L}]+", ""))
    share = (F.length(low) - F.length(F.translate(low, VIETNAMESE, ""))) / letters
    return F.when(letters > 0, F.when(share >= 0.05, "vi").when(share >= 0.005, "mixed").otherwise("en"))


def ladder(c: Column, steps: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first pattern that fits."""
    out = None
    for name, pattern in steps:
        hit = c.rlike(f"(?iu){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def seniority_of(c: Column) -> Column:
    return ladder(F.coalesce(c, F.lit("")), SENIORITY, NO_LEVEL)


def title_group_of(c: Column) -> Column:
    return ladder(F.coalesce(c, F.lit("")), TITLE_GROUPS, NO_GROUP)


def merge_flags(*flags: Column) -> Column:
    """Arrays of flags, one after the other, each flag where it first stands."""
    return F.array_distinct(F.concat(*flags))


def flags(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))
