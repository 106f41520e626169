"""Job titles in one form: recruitment noise, levels and lists of tools taken out, words in title case, and flags of what was done.

A title passes through steps, each an expression over a struct of its text and flags, so that a whole table of titles is
rewritten inside the JVM. Conditions on a bracket or a segment are asked of its parts as an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import flags, squeeze

U = "(?iuU)"
# Words and phrases that decide what is taken out or kept, and how words are spelled.
ABBREVIATIONS = {"Sr": "Senior", "Jr": "Junior", "Mgr": "Manager", "Eng": "Engineer", "Dev": "Developer", "Dir": "Director", "Assoc": "Associate"}
SALARY = U + r"(\b(up\s*to|upto|lên\s*đến|tới)\s*\d[\d,.]*\s*(triệu|USD|VND|tr|M|K)?\b|\$\s*\d[\d,.]*|\d[\d,.]*\s*\$)"
PERKS = U + r"\s*[-–]\s*(bonus|thưởng|package|allowance|incentive)\b.*$"
WANTED_LANGUAGE = U + r"\s*[,\-–|]\s*(english\s+required|yêu\s+cầu\s+tiếng\s+anh|fluent\s+english).*$|\s+(english|tiếng\s+anh(\s+tốt)?)\s*$"
BRACKETED_LANGUAGE = U + r"[(\[]\s*[^()\[\]]*\b(english|japanese|korean|chinese|tiếng\s+anh|tiếng\s+nhật|tiếng\s+hàn)\b[^()\[\]]*[)\]]"
NOISE = U + r"thu\s+nhập|lương|salary|\bup\s*to\b|\bupto\b|triệu|\d\s*(tr|m|k|usd|vnđ|vnd)\b|kinh\s+nghiệm|\bkn\b|\btại\b|xe\s+đưa\s+đón|bonus|thưởng|nghỉ\s+t7|t7\s*&\s*cn|\bid\s*\d+|quận\s*\d+|\bonsite\b|hội\s+sở|tiếng\s+anh|english|ob\s+sớm"
LEVEL = r"(?:senior|sr\.?|snr\.?|sen|junior|jr\.?|middle|mid(?:[\s-]level)?|fresher|entry[\s-]level)"
ROLE_NOUNS = "analyst|engineer|scientist|developer|architect|specialist|consultant|researcher|administrator|manager|lead|expert|programmer"
OTHER_ROLES = r"intern|developer|tester|chuyên\s+viên|kỹ\s+sư|nhân\s+viên|trưởng\s+nhóm|trưởng\s+phòng|quản\s+lý|thực\s+tập\s+sinh|chuyên\s+gia"
TWO_ROLES = "analyst|engineer|scientist|developer|architect|manager|designer|consultant|specialist|researcher"
SMALL_WORDS = "a an the and or but for nor on at to by of in with".split()
UPPER_WORDS = "ai ml nlp llm bi ux ui api sql etl elt qa ba hr sap erp aws gcp az ci cd oop".split()
DOMAIN_GROUPS = ("NLP, Vision & Multimodal AI", "Applied Analytics & Business Platforms", "Security Engineering")
DOMAIN_SKILLS = (
    "Machine Learning", "Deep Learning", "Reinforcement Learning", "Recommendation Systems", "Statistics", "Statistical Analysis", "Generative AI",
    "Large Language Models", "Agentic AI", "AI Agents", "Multi-Agent Systems", "Retrieval-Augmented Generation", "Big Data", "Data Architecture",
    "Data Governance", "Data Quality", "Data Security", "Cloud Computing", "MLOps", "DevOps", "Distributed Systems", "Real-Time Processing", "Stream Processing",
)
MORE_TOOLS = ("nosql", "t-sql", "pl/sql", "hive", "sas", "spss", "matlab", "vba", "javascript", "gcp", "aws", "azure", "excel", "ssis", "ssrs", "informatica", "talend", "qlik", "qlik sense")
SHORT, LONG = 3, 100

_BRACKET = r"[(\[][^()\[\]]*[)\]]"
_DELIMITER = r"\s+[-–|]\s+|,\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _trim(c: Column, marks: str) -> Column:
    """Without the marks (a character class) at both ends, and with single blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"\s{2,}", " "), f"^[{marks}]+|[{marks}]+$", "")


def _without_brackets(c: Column, goes: Callable[[Column], Column]) -> Column:
    """Brackets whose contents meet the condition become a blank."""
    pieces = F.regexp_extract_all(c, F.lit(f"({_BRACKET}|[^(\\[]+|[(\\[])"), 1)
    inside = lambda p: F.regexp_replace(p, r"^[(\[]\s*|\s*[)\]]$", "")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{_BRACKET}$") & goes(inside(p)), " ").otherwise(p)), "")


def segments(c: Column) -> Column:
    """array<struct<before, text>> of the segments between delimiters outside brackets; `before` is the delimiter."""
    pieces = F.regexp_extract_all(c, F.lit(rf"({_DELIMITER}|[(\[]|[)\]]|(?:(?!{_DELIMITER})[^()\[\]])+|.)"), 1)
    kind = "struct<depth: int, done: array<struct<before: string, text: string>>, before: string, text: string>"
    start = F.from_json(F.lit('{"depth": 0, "done": [], "before": "", "text": ""}'), kind)

    def step(s: Column, p: Column) -> Column:
        cut = (s["depth"] == 0) & p.rlike(f"^({_DELIMITER})$")
        depth = s["depth"] + F.when(p.isin("(", "["), 1).when(p.isin(")", "]"), -1).otherwise(0)
        whole = F.array(F.struct(s["before"].alias("before"), s["text"].alias("text")))
        return F.struct(
            depth.cast("int").alias("depth"),
            F.when(cut, F.concat(s["done"], whole)).otherwise(s["done"]).alias("done"),
            F.when(cut, p).otherwise(s["before"]).alias("before"),
            F.when(cut, "").otherwise(F.concat(s["text"], p)).alias("text"),
        )

    return F.aggregate(pieces, start, step, lambda s: F.concat(s["done"], F.array(F.struct(s["before"].alias("before"), s["text"].alias("text")))))


def _is_place(c: Column, places: list[str]) -> Column:
    """Whether every part between slashes, commas and 'và' names a place; places are patterns."""
    if not places:
        return F.lit(False)
    parts = F.filter(F.split(c, r"(?iuU)[/,]|\bvà\b"), lambda p: F.trim(p) != "")
    known = "(?iu)" + "|".join(f"(?:{p})" for p in places)
    return (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(known))


def _is_tools(c: Column, tools: list[str]) -> Column:
    """Whether all items of the list are tools, and there is one."""
    items = F.filter(F.transform(F.split(c, r"(?iuU)\s*(?:,|/|&|\||;|\band\b|\bvà\b)\s*"), lambda i: F.regexp_replace(i, r"^[ .:\-–]+|[ .:\-–]+$", "")), lambda i: i != "")
    return (F.size(items) > 0) & F.forall(items, lambda i: F.lower(i).isin(*tools))


def _step(state: Column, rewrite: Callable[[Column], Column], flag: str | None = None, last: Callable[[Column], Column] | None = None) -> Column:
    """The state (text, flags) after a rewriting; the flag is set where it changed the text, `last` tidies in any case."""

    def after(new: Column, old: Column) -> Column:
        f = old["flags"] if flag is None else F.when(new != old["text"], F.array_union(old["flags"], F.array(F.lit(flag)))).otherwise(old["flags"])
        return F.struct((last(new) if last else new).alias("text"), f.alias("flags"))

    return let(state, lambda s: let(rewrite(s["text"]), lambda new: after(new, s)))


def _unless_empty(pattern: str, put: str = "") -> Callable[[Column], Column]:
    """Replaces the pattern where something is left."""
    return lambda t: let(F.regexp_replace(t, pattern, put), lambda new: F.when(F.trim(new) != "", new).otherwise(t))


def _replaced(*rules: tuple[str, str]) -> Callable[[Column], Column]:
    def f(t: Column) -> Column:
        for pattern, put in rules:
            t = F.trim(F.regexp_replace(t, pattern, put))
        return t

    return f


def _without_noise(places: list[str]) -> list[tuple]:
    noisy = lambda t: t.rlike(NOISE) | _is_place(t, places)

    def loud_segments(t: Column) -> Column:
        kept = lambda x, i: (i == 0) | (F.trim(x["text"]) == "") | ~noisy(x["text"])
        return F.array_join(F.transform(F.filter(segments(t), kept), lambda x: F.concat(x["before"], x["text"])), "")

    flag = "RECRUITMENT_NOISE_REMOVED"
    return [
        (lambda t: _without_brackets(t, noisy), flag, None),
        (loud_segments, flag, None),
        (_unless_empty(U + r"\s+(lương|thu\s+nhập)\b.*$"), flag, lambda t: _trim(t, r" ,\-–|")),
    ]


def _without_level() -> list[tuple]:
    flag = "SENIORITY_REMOVED"
    all_levels = lambda t: let(F.filter(F.split(t, r"\s*[,/&|-]\s*"), lambda i: F.trim(i) != ""), lambda x: (F.size(x) > 0) & F.forall(x, lambda i: F.trim(i).rlike(f"{U}^{LEVEL}$")))
    return [
        (lambda t: F.regexp_replace(t, rf"{U}^\s*{LEVEL}\s*/\s*(?!{LEVEL}(?:\s|$))(?=\S+\s)", ""), flag, None),
        (_unless_empty(rf"{U}^\s*{LEVEL}(?:\s*[/&,-]\s*{LEVEL})*\s*(?:[/&,-]\s*)?(?=\S)"), flag, None),
        (lambda t: _without_brackets(t, all_levels), flag, None),
        (_unless_empty(rf"{U}\s+{LEVEL}\s*$"), flag, lambda t: _trim(t, r" ,\-–")),
    ]


def _without_tools(tools: list[str]) -> Callable[[Column], Column]:
    """Lists of tools in brackets, after the last delimiter and after the last role word; undone where the title names no role, before or after."""
    role = lambda t: t.rlike(rf"{U}\b({ROLE_NOUNS}|{OTHER_ROLES})\b")
    tail = rf"{U}^(.*\b(?:{ROLE_NOUNS})\b)(.*)$"
    last = r"^(.*?)\s+[-–|:]\s+([^-–|:]+)$"

    def f(t: Column) -> Column:
        a = _without_brackets(t, lambda x: _is_tools(x, tools))
        b = let(a, lambda x: F.when(x.rlike(last) & _is_tools(F.regexp_extract(x, last, 2), tools), F.regexp_extract(x, last, 1)).otherwise(x))
        c = let(b, lambda x: let(F.regexp_extract(x, tail, 2), lambda y: F.when((F.trim(y) != "") & _is_tools(F.regexp_replace(y, "^[ ,]+|[ ,]+$", ""), tools), F.regexp_extract(x, tail, 1)).otherwise(x)))
        return let(c, lambda new: F.when((new != t) & role(t) & role(new), new).otherwise(t))

    return f


def title_case(c: Column) -> Column:
    """Words with a capital each; acronyms and words with a shape of their own as they are spelled, small words inside in lower case."""
    marks = r"()\[\]{},.;:!?&\-–"
    letters = F.regexp_replace(c, r"\P{L}+", "")

    def word(w: Column, i: Column, loud: Column) -> Column:
        core = F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")
        first = F.regexp_extract(w, r"^(\P{L}*)(\p{L})(.*)$", 2)
        rest = F.regexp_extract(w, r"^(\P{L}*)(\p{L})(.*)$", 3)
        capital = F.when(first == "", w).otherwise(F.concat(F.regexp_extract(w, r"^(\P{L}*)", 1), F.upper(first), F.when(loud, F.lower(rest)).otherwise(rest)))
        return (
            F.when(~loud & core.rlike(r"^\p{Lu}{2,5}$"), w)
            .when(w.rlike(r"\+\+|(?<=[a-z])[A-Z]|/"), w)
            .when(F.lower(core).isin(*UPPER_WORDS), F.replace(w, core, F.upper(core)))
            .when((i > 0) & (core == w) & F.lower(core).isin(*SMALL_WORDS), F.lower(core))
            .otherwise(capital)
        )

    return let(letters.rlike(r"^\p{Lu}+$"), lambda loud: F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w, i: word(w, i, loud)), " "))


def normal_title(raw: Column, places: list[str] | None = None, tools: list[str] | None = None) -> Column:
    """struct(title, flags) of a raw title; null and MISSING_JOB_TITLE for a null or blank one.

    places: patterns of place names; a bracket or segment of places alone is noise. tools: names in lower case, to which MORE_TOOLS are added; a list of them alone
    is taken out, None leaves all in.
    """
    known = sorted({*tools, *MORE_TOOLS}) if tools is not None else []
    state = F.struct(squeeze(raw).alias("text"), F.array().cast("array<string>").alias("flags"))
    end = (r"[\s/,\-–|]+$", "")
    steps: list[tuple] = [
        *_without_noise(places or []),
        (_replaced((r"^[\d]+\.\s*|^[-*#•]\s*", ""), (SALARY, ""), (PERKS, ""), (WANTED_LANGUAGE, ""), (BRACKETED_LANGUAGE, " "), (r"[(\[]\s*[)\]]", " "), (r"([(\[])\s+", "$1"), (r"\s+([)\]])", "$1"), (r"\s+/\s*|\s*/\s+", " / "), (r"\s{2,}", " "), end), None, None),
        (_replaced(*((rf"{U}\b{k}\b\.?", v) for k, v in ABBREVIATIONS.items())), None, None),
        *_without_level(),
    ]
    if known:
        steps.append((_without_tools(known), "TECH_SUFFIX_REMOVED", lambda t: _trim(t, r" ,\-–|")))
    steps.append((_replaced(end), None, None))
    for rewrite, flag, last in steps:
        state = _step(state, rewrite, flag, last)
    roles = rf"{U}(?:\w+\s+)*(?:{TWO_ROLES})\s*[/|]\s*(?:\w+\s+)*(?:{TWO_ROLES})"
    long_enough = lambda t: F.length(t) >= SHORT
    more = lambda t: flags(("TITLE_TOO_SHORT", ~long_enough(t)), ("AMBIGUOUS_TITLE", long_enough(t) & t.rlike(roles)), ("TITLE_TOO_LONG", F.length(t) > LONG))
    done = let(state, lambda s: let(title_case(s["text"]), lambda t: F.struct(F.when(t != "", t).alias("title"), F.concat(s["flags"], more(t)).alias("flags"))))
    none = F.struct(F.lit(None).cast("string").alias("title"), F.array(F.lit("MISSING_JOB_TITLE")).alias("flags"))
    return F.when(F.coalesce(squeeze(raw), F.lit("")) == "", none).otherwise(done)
