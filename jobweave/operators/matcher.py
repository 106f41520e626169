"""Dictionary matcher: the terms of a taxonomy in texts, overlaps settled in favour of the longest.

All terms are one automaton, built in each task from the taxonomy (a fixed list, checked for size), which reads a text once;
matches are then held against word bounds, case and context. Texts stay where they are read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.plans.staging import even

MOST_TERMS = 500_000
# Names matched with their case; letters that must not follow C and R; what must stand somewhere in a text for an abbreviation.
CASED = frozenset({"C", "R", "Go"})
NOT_AFTER = {"C": "#+", "R": "&"}
CONTEXT = {"CV": ("computer vision", "opencv", "image processing", "image recognition", "object detection", "video processing", "vision model", "visual recognition")}
#: Groups of skills at the core of data and AI; the others are software, infrastructure, security and general tools.
CORE_GROUPS = (
    "Data Analysis & BI", "Data Engineering & Architecture", "Machine Learning, Statistics & Optimization", "Generative AI & Agentic Systems",
    "NLP, Vision & Multimodal AI", "Distributed, Streaming & Big Data", "Data Quality, Testing & Observability", "Applied Analytics & Business Platforms",
)
KINDS = {"canonical": 1, "alias": 2, "abbreviation": 3}


def terms_of(taxonomy: list[dict]) -> list[tuple[str, str, str, str, bool]]:
    """(skill_id, canonical_name, kind, term, cased) of names, aliases and abbreviations."""
    out = []
    for row in taxonomy:
        i, name = row["skill_id"], row["canonical_name"]
        out.append((i, name, "canonical", name, name in CASED))
        out += [(i, name, "alias", t.strip(), False) for t in (row.get("aliases") or "").split(";") if t.strip()]
        if (row.get("abbreviation") or "").strip():
            out.append((i, name, "abbreviation", row["abbreviation"].strip(), True))
    return out


def plain(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


class Matcher:
    def __init__(self, taxonomy: list[dict]):
        import ahocorasick

        terms = terms_of(taxonomy)
        if len(terms) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} terms")
        self.order = {row["skill_id"]: k for k, row in enumerate(taxonomy)}
        self.auto = ahocorasick.Automaton()
        by: dict[str, list] = {}
        for t in terms:
            by.setdefault(re.sub(r"\s+", " ", plain(t[3])).lower(), []).append(t)
        for key, values in by.items():
            self.auto.add_word(key, (key, values))
        self.auto.make_automaton()

    def candidates(self, text: str) -> list[tuple[str, str, str, str, int, int]]:
        """(skill_id, canonical_name, kind, matched text, start, end) of every term that stands between word bounds."""
        whole = plain(text)
        low = whole.lower()
        if len(low) != len(whole):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in whole)
        # Runs of blanks count as one: where they end in the shortened text, and how much was cut out before.
        ends, cut, removed = [], [], 0
        for m in re.finditer(r"\s{2,}", low):
            ends.append(m.start() - removed + 1)
            removed += m.end() - m.start() - 1
            cut.append(removed)
        joined = re.sub(r"\s+", " ", low) if ends or re.search(r"[^\S ]", low) else low
        at = lambda i: i + (cut[k - 1] if (k := bisect.bisect_right(ends, i)) else 0)
        out = []
        for end, (key, values) in self.auto.iter(joined):
            a, b = at(end - len(key) + 1), at(end) + 1
            if (a and _word(whole[a - 1])) or (b < len(whole) and _word(whole[b])):
                continue
            found = whole[a:b]
            for skill, name, kind, term, cased in values:
                if cased and re.sub(r"\s+", " ", found) != re.sub(r"\s+", " ", plain(term)):
                    continue
                if found in NOT_AFTER and whole[b : b + 1] and whole[b] in NOT_AFTER[found]:
                    continue
                if kind == "abbreviation" and term in CONTEXT and not any(_stands(c, joined) for c in CONTEXT[term]):
                    continue
                out.append((skill, name, kind, found, a, b))
        return out

    def matches(self, text: str) -> list[tuple[str, str, str, str, int, int]]:
        """The first match of each skill that no longer match of another skill overlaps, in the taxonomy's order."""
        taken: list[tuple] = []
        for c in sorted(self.candidates(text), key=lambda c: (c[4] - c[5], KINDS[c[2]], c[4], c[0])):
            if all(c[0] == t[0] or c[5] <= t[4] or c[4] >= t[5] for t in taken):
                taken.append(c)
        first: dict[str, tuple] = {}
        for c in sorted(taken, key=lambda c: (c[4], c[5])):
            first.setdefault(c[0], c)
        return sorted(first.values(), key=lambda c: self.order[c[0]])


def _stands(phrase: str, text: str) -> bool:
    """Whether the phrase stands in the text between word bounds."""
    at = text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if not (at and _word(text[at - 1])) and not (end < len(text) and _word(text[end])):
            return True
        at = text.find(phrase, at + 1)
    return False


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


MATCH = "struct<skill_id: string, canonical_name: string, kind: string, term: string, start: int, end: int>"


def extract(df: DataFrame, key: str, text: str, taxonomy: DataFrame) -> DataFrame:
    """(key, matches): the skills of each text with their places, in the order of the taxonomy's file; none for null and empty texts."""
    rows = [r.asDict() for r in taxonomy.select("skill_id", "canonical_name", "abbreviation", "aliases").limit(MOST_TERMS + 1).collect()]
    kind = dict(df.dtypes)[key]
    names = ("skill_id", "canonical_name", "kind", "term", "start", "end")
    item = pa.list_(pa.struct([*[(n, pa.string()) for n in names[:4]], ("start", pa.int32()), ("end", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(rows)
        for b in batches:
            found = [[dict(zip(names, x)) for x in m.matches(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item)], ["k", "matches"])

    return even(df.select(F.col(key).alias("k"), F.col(text).cast("string"))).mapInArrow(read, f"k {kind}, matches array<{MATCH}>").withColumnRenamed("k", key)


def skill_lists(matches: DataFrame) -> DataFrame:
    """(…, extracted_skills, skill_count): names in the taxonomy's order; an empty list where none was found."""
    return matches.withColumn("extracted_skills", F.col("matches.canonical_name")).withColumn("skill_count", F.size("matches")).drop("matches")


def skill_matrix(matches: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """One 0/1 column for each id; rows without skills and columns without rows stay."""
    has = F.col("matches.skill_id")
    return matches.select(key, *[F.array_contains(has, i).cast("tinyint").alias(i) for i in ids])


def recount(matches: DataFrame) -> DataFrame:
    """(skill_id, n_documents) of the skills found anywhere."""
    return matches.select(F.explode("matches").alias("m")).groupBy("m.skill_id").agg(F.count("*").alias("n_documents"))


def evidence(matches: DataFrame, key: str) -> DataFrame:
    """(skill_id, canonical_name, key, kind, term, start, end): a row for each skill of each text, with the place where it was found."""
    return matches.select(key, F.explode("matches").alias("m")).select("m.skill_id", "m.canonical_name", key, "m.kind", "m.term", "m.start", "m.end")


def recount_differs(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(skill_id, observed, counted) of the skills whose number in the taxonomy isn't what was counted."""
    both = taxonomy.select("skill_id", F.col("observed_count").try_cast("long").alias("observed")).join(counts, "skill_id", "left")
    return both.select("skill_id", "observed", F.coalesce("n_documents", F.lit(0).cast("long")).alias("counted")).filter(~F.col("observed").eqNullSafe(F.col("counted")))


def group_shares(basket: DataFrame, taxonomy: DataFrame, core: list[str], key: str = "job_id") -> DataFrame:
    """(key, n_skills, core_share): the share of each posting's skills that lies in the core groups."""
    t = F.broadcast(taxonomy.select(F.col("canonical_name").alias("skill"), "skill_group"))
    return basket.join(t, "skill", "left").groupBy(key).agg(F.count("*").alias("n_skills"), F.round(F.avg(F.coalesce(F.col("skill_group").isin(core), F.lit(False)).cast("double")), 4).alias("core_share"))
