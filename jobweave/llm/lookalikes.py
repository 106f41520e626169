"""One character form for text that looks the same.

Each Arrow batch is handed to an in-memory DuckDB inside the Python worker and rewritten by one embedded SQL
statement: nfc_normalize, translate and regular expressions. No shuffle; rows stay in their partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from jobweave.llm.common import duck

SLICE = 2000  # rows handed to DuckDB at once
# The characters of Unicode that stand in for ordinary ones.
# Blanks other than U+0020 that are drawn as one.
BLANKS = "               　"
# Hyphens that are drawn like U+002D.
HYPHENS = "‐‑﹣－"
# Characters without a shape of their own.
UNSEEN = r"\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E007F}"
# Letters of Cyrillic, Greek and Armenian drawn like a Latin letter, and the Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјкорсухԁԛԝһӏүԍ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWaesijkopcyxdqwhlyg"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovcj"
ARMENIAN = "ՕՏԼօոսհյցզ"
ARMENIAN_AS = "OSLonuhjgq"
# Latin letters drawn like another Latin letter of the texts.
LATIN = "ÐƉɑɡɩ"
LATIN_AS = "ĐĐagi"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _compatibility() -> tuple[str, str]:
    """Full-width and mathematical letters and digits, found by their compatibility mapping rather than listed."""
    import unicodedata

    wide = [c for c in map(chr, range(0xFF01, 0xFF5F)) if c.isalnum()]
    maths = [c for c in map(chr, [*range(0x1D400, 0x1D800), *range(0x2100, 0x2150)]) if "<font>" in unicodedata.decomposition(c)]
    pairs = [(c, unicodedata.normalize("NFKC", c)) for c in wide + maths]
    pairs = [(c, n) for c, n in pairs if len(n) == 1 and n.isascii()]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


COMPAT, COMPAT_AS = _compatibility()
WIDE_SIGNS = "".join(c for c in map(chr, range(0xFF01, 0xFF5F)) if not c.isalnum() and c != "－")
WIDE_SIGNS_AS = "".join(chr(ord(c) - 0xFEE0) for c in WIDE_SIGNS)
# Marks and brackets among them that East Asian text uses in its own right.
EAST = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"
PICTURE = r"[\p{So}\p{Sk}\p{Sm}#*0-9\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2190}-\x{21FF}]"
# Scripts that write with the joiners.
JOINED = r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}]"
WORDS = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+"
FOREIGN = r"[\p{Cyrillic}\p{Greek}\p{Armenian}]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql(source: str, keys: list[str], value: str, composed: bool = True) -> str:
    """The statement: source's keys, value, and `unified`, the value in its one form (null for null).

    * Suspicious values only go through the rewriting; every other value, so all of plain ASCII, is passed on as it is.
    * Joiners and variation selectors stay in emoji and in scripts that write with them.
    * A word with a Latin letter has its look-alikes mapped. A word wholly of look-alikes is mapped unless a
      neighbouring word is truly of another script; a word with any letter of its own stays as it is.
    * Full-width signs are mapped with full-width letters or digits in the value, or, brackets apart, in a value
      without East Asian script.
    * composed=False passes values on that are only not composed (NFC), for callers that drop accents anyway.
    """
    like, like_as = CYRILLIC + GREEK + ARMENIAN, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS
    own = f"[^\\P{{L}}\\p{{Latin}}{like}]"  # a letter neither Latin nor a look-alike
    k = ", ".join(keys)
    true_word = lambda t: f"coalesce(regexp_matches({t}, {_quoted(FOREIGN)}) AND regexp_matches({t}, {_quoted(own)}) AND NOT regexp_matches({t}, '\\p{{Latin}}'), false)"
    ligatures = "v1"
    for a, b in LIGATURES.items():
        ligatures = f"replace({ligatures}, '{a}', '{b}')"
    brackets = "（）［］｛｝｟｠"
    marks = "".join(c for c in WIDE_SIGNS if c not in brackets)
    marks_as = "".join(chr(ord(c) - 0xFEE0) for c in marks)
    suspicious = "[" + BLANKS + HYPHENS + UNSEEN + COMPAT + WIDE_SIGNS + LATIN + "".join(LIGATURES) + (r"\p{M}" if composed else "") + r"\p{Cyrillic}\p{Greek}\p{Armenian}]"
    return f"""
    WITH s0 AS (SELECT {k}, {value} AS v FROM {source}),
    s1 AS (SELECT {k}, v, CASE WHEN strlen(v) > length(v) THEN regexp_matches(v, {_quoted(suspicious)}){" OR nfc_normalize(v) <> v" if composed else ""} ELSE false END AS odd FROM s0),
    s2 AS (SELECT {k}, v, nfc_normalize(regexp_replace(v,
        {_quoted(f"({PICTURE}[\\x{{FE0E}}\\x{{FE0F}}\\p{{Sk}}]*(?:\\x{{200D}}{PICTURE}[\\x{{FE0E}}\\x{{FE0F}}\\p{{Sk}}]*)*|{JOINED}[\\x{{200C}}\\x{{200D}}])|[{UNSEEN}]")},
        '\\1', 'g')) AS v1 FROM s1 WHERE odd),
    s3 AS (SELECT {k}, v, translate({ligatures}, {_quoted(BLANKS + HYPHENS + LATIN + COMPAT)}, {_quoted(" " * len(BLANKS) + "-" * len(HYPHENS) + LATIN_AS + COMPAT_AS)}) AS v2 FROM s2),
    s4 AS (SELECT {k}, v, CASE
        WHEN NOT regexp_matches(v, {_quoted("[" + WIDE_SIGNS + "]")}) THEN v2
        WHEN regexp_matches(v, '[０-９Ａ-Ｚａ-ｚ]') THEN translate(v2, {_quoted(WIDE_SIGNS)}, {_quoted(WIDE_SIGNS_AS)})
        WHEN NOT regexp_matches(v, {_quoted(EAST)}) THEN translate(v2, {_quoted(marks)}, {_quoted(marks_as)})
        ELSE v2 END AS v3 FROM s3),
    s5 AS (SELECT {k}, v, v3, CASE WHEN regexp_matches(v3, {_quoted(FOREIGN)}) THEN regexp_extract_all(v3, {_quoted(WORDS)}) END AS w FROM s4),
    s6 AS (SELECT {k}, v, nfc_normalize(CASE WHEN w IS NULL THEN v3 ELSE array_to_string(list_transform(w, lambda t, i:
        CASE WHEN NOT regexp_matches(t, {_quoted("[" + like + "]")}) THEN t
             WHEN regexp_matches(t, '\\p{{Latin}}') THEN translate(t, {_quoted(like)}, {_quoted(like_as)})
             WHEN regexp_matches(t, {_quoted(own)}) THEN t
             WHEN {true_word("w[i - 2]")} OR {true_word("w[i + 2]")} THEN t
             ELSE translate(t, {_quoted(like)}, {_quoted(like_as)}) END), '') END) AS u FROM s5)
    SELECT {k}, v AS {value}, v AS unified FROM s1 WHERE NOT odd
    UNION ALL
    SELECT {k}, v AS {value}, u AS unified FROM s6"""


def unify(df: DataFrame, key: str, columns: list[str], only_changed: bool = False) -> DataFrame:
    """Rows (key, field, unified) of the columns' values, `unified` in one consistent form.

    A null value gives a null (no row with only_changed); empty text stays empty; repeated rows come out as often
    as they went in; other columns of df are not read, whatever their names. only_changed keeps the values whose
    form changed. An empty table gives an empty result.
    """
    names = [f"c{i}" for i in range(len(columns))]
    narrow = df.select(df[key].cast("string").alias("k"), *[df[c].cast("string").alias(n) for c, n in zip(columns, names)])
    statement = "SELECT k, CASE field " + " ".join(f"WHEN '{n}' THEN {_quoted(c)}" for n, c in zip(names, columns)) + " END AS field, unified FROM (" + sql("(SELECT k, unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS field, unnest([" + ", ".join(names) + "]) AS value FROM batch)", ["k", "field"], "value") + ")" + (" WHERE unified <> value" if only_changed else "")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duck()
        out = pa.schema([("k", pa.string()), ("field", pa.string()), ("unified", pa.string())])
        for whole in batches:
            for b in (whole.slice(k, SLICE) for k in range(0, whole.num_rows, SLICE)):
                con.register("batch", pa.Table.from_batches([b]))
                got = con.sql(statement).to_arrow_table().cast(out)
                con.unregister("batch")
                yield from got.to_batches()

    return narrow.mapInArrow(rewrite, "k string, field string, unified string").withColumnRenamed("k", key)
