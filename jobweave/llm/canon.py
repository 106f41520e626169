"""Freely typed values mapped to the entries of a reference list.

The entries' names stand in a BK-tree under the Levenshtein distance, a true metric, so that the triangle inequality
prunes branches and still gives every name within the radius. Each stretch of words of a value is looked up; the
best stretches that don't overlap name the value's entries. The tree is built in each task from the reference
list's block, whose size is bounded; a longer list is taken in blocks, and the blocks' stretches are merged by value.
Values are handled where they are read, with a bounded memory of stretches already looked up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

NAMES_AT_ONCE = 200_000  # names in one tree, some 100 MB
REMEMBERED = 200_000
_LIKE = str.maketrans(CYRILLIC + GREEK + "đĐðÐß", CYRILLIC_AS + GREEK_AS + "dDdDs")
_WORD = re.compile(r"[^\W_]+")
# Words around a title or place that don't change what it names, in folded spelling.
AROUND = frozenset("sr jr snr senior junior lead principal staff fresher intern mid middle entry level head hot new urgent gap tuyen tuyen dung can remote x".split())
SHORT = {"eng": "engineer", "engr": "engineer", "dev": "developer", "mgr": "manager", "admin": "administrator", "sci": "scientist"}
_TITLE_PARTS = re.compile(r"\s[-–|@]\s|[|@()\[\]【】（）]|\btại\b|\btai\b", re.I)


def radius(n: int) -> int:
    """Edits allowed for a name of n letters."""
    return 0 if n <= 4 else 1 if n <= 9 else 2


@lru_cache(maxsize=100_000)
def fold(s: str) -> str:
    """Letters and digits of s without case, accents, look-alikes and unseen characters."""
    d = unicodedata.normalize("NFKD", s).translate(_LIKE)
    return "".join(c for c in d if c.isalnum()).lower()


def distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of an integer."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score, plus, minus = (1 << len(a)) - 1, 1 << len(a) - 1, len(a), (1 << len(a)) - 1, 0
    for c in b:
        eq = where.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        score += bool(up & top) - bool(down & top)
        up = up << 1 | 1
        plus = (down << 1 | ~((eq | minus) | up)) & full
        minus = up & (eq | minus) & full
    return score


def edits(a: str, b: str) -> int:
    """Edits from a to b where two neighbours changed round are one edit; used on what the tree has found."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], last[j - 2] + 1)
    return row[-1]


class Tree:
    """A BK-tree: each child of a node is filed under its distance from it."""

    def __init__(self, names: list[str]):
        self.root = None
        for n in dict.fromkeys(names):
            if self.root is None:
                self.root = (n, {})
                continue
            node = self.root
            while (d := distance(n, node[0])) in node[1]:
                node = node[1][d]
            node[1][d] = (n, {})

    def within(self, query: str, most: int) -> list[str]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            name, children = todo.pop()
            d = distance(query, name)
            if d <= most:
                out.append(name)
            todo += [c for e, c in children.items() if d - most <= e <= d + most]
        return out


class Matcher:
    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.of: dict[str, set[int]] = {}
        for ref, names in entries:
            for n in names:
                if key := fold(n):
                    self.of.setdefault(key, set()).add(ref)
        #: Short names of one word (initials) must stand letter by letter, accents included.
        self.loose = {fold(n) for _, names in entries for n in names if len(_WORD.findall(n)) > 1}
        self.exact = {unicodedata.normalize("NFC", n).strip().lower() for _, names in entries for n in names if len(fold(n)) <= 4}
        self.tree = Tree([n for n in self.of if radius(len(n))])
        long = [len(n) for n in self.of]
        self.longest = max(long, default=0) + 2
        self.words = max((len(_WORD.findall(n)) for _, names in entries for n in names), default=1) + 1
        self.seen: dict[str, tuple[int, str] | None] = {}

    def name(self, s: str) -> tuple[int, str] | None:
        """(edits, name) of the nearest name within its radius; of equal ones the first by code point."""
        if s in self.seen:
            return self.seen[s]
        best = (0, s) if s in self.of else None
        if best is None and 4 <= len(s) <= self.longest:
            for n in self.tree.within(s, 4 if len(s) >= 9 else 2):
                d = edits(s, n)
                if d <= radius(len(n)) and (best is None or (d, n) < best):
                    best = (d, n)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[s] = best
        return best

    def stretches(self, value: str, title: bool) -> list[tuple[int, int, int, int, str]]:
        """(score, first word, end, edits, name) of all stretches of the value's words that name something."""
        text = unicodedata.normalize("NFKC", "".join(c for c in value if unicodedata.category(c) != "Cf")).translate(_LIKE_TITLE)
        spans = [(m.group(), m.start()) for m in _WORD.finditer(unicodedata.normalize("NFC", text))]
        folded = [fold(w) for w, _ in spans]
        if title:
            folded = [SHORT.get(f, f) if i else f for i, f in enumerate(folded)]
        out = []

        def add(key: str, i: int, j: int) -> None:
            hit = self.name(key)
            if hit and (len(hit[1]) > 4 or self._stands(value, text, spans, folded, i, j, title)):
                out.append((len(hit[1]) - 3 * hit[0], i, j, *hit))

        n = len(spans)
        for i in range(n):
            key = ""
            for j in range(i, min(n, i + self.words)):
                key += folded[j]
                if len(key) > self.longest:
                    break
                add(key, i, j + 1)
        if title:
            for m in re.finditer(",", text):  # 'Engineer, Data Platform'
                at = sum(p < m.start() for _, p in spans)
                for i in range(max(0, at - 2), at):
                    for j in range(at + 1, min(n, at + 4) + 1):
                        add("".join(folded[at:j] + folded[i:at]), i, j)
        return out

    def _stands(self, value: str, text: str, spans: list, folded: list[str], i: int, j: int, title: bool) -> bool:
        """Whether a short name stands there by itself: letter by letter, and, in a title, with nothing beside it that matters."""
        if j - i > 1 and "".join(folded[i:j]) in self.loose:
            return True
        if " ".join(w.lower() for w, _ in spans[i:j]) not in self.exact and "".join(w.lower() for w, _ in spans[i:j]) not in self.exact:
            return False
        if not title or any(w.isupper() for w, _ in spans[i:j]) and not value.isupper():
            return True
        marks = [m.start() for m in _TITLE_PARTS.finditer(text)] + [m.start() for m in re.finditer(",", text)]
        part = lambda k: sum(x < spans[k][1] for x in marks)
        return all(k in range(i, j) or part(k) != part(i) or folded[k] in AROUND or folded[k].isdigit() for k in range(len(spans)))

    @staticmethod
    def chosen(found: list[tuple[int, int, int, int, str]], several: bool) -> list[str]:
        taken: list[tuple[int, int, int, int, str]] = []
        for x in sorted(found, key=lambda x: (-x[0], x[3], x[1], x[2], x[4])):
            if all(x[2] <= t[1] or x[1] >= t[2] for t in taken):
                taken.append(x)
                if not several:
                    break
        return [x[4] for x in taken]


_LIKE_TITLE = str.maketrans(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)


def map_to_canon(df: DataFrame, key: str, value: str, reference: DataFrame, ref_key: str, name: str, aliases: str | None = "aliases", several: bool = False, title: bool = False, blanks: bool = False) -> DataFrame:
    """Rows (key, ref_key): the entries of `reference` that each non-blank value of df names; 0 where it names none.

    With `several` a value may name more than one entry, a row each; else the longest and nearest name decides. A name shared by
    entries gives each of them. Null and blank values give no row, or 0 with `blanks`; repeated rows repeat their result; an empty reference gives 0 throughout;
    other columns are not read. Names beyond NAMES_AT_ONCE are taken in blocks of entries.
    """
    kind = dict(df.dtypes)[key]
    spread_names = F.filter(F.concat(F.array(F.col(name)), F.split(F.coalesce(F.col(aliases), F.lit("")), ";") if aliases else F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    entries = reference.select(F.col(ref_key).cast("long").alias("r"), spread_names.alias("n"))
    # The size is checked first; each block is a broadcast of its own, fetched by the tasks that need it.
    n_blocks = max(1, -(-int(entries.agg(F.sum(F.size("n"))).first()[0] or 0) // NAMES_AT_ONCE))
    part = lambda i: entries if n_blocks == 1 else entries.filter(F.pmod(F.xxhash64("r"), F.lit(n_blocks)) == i)
    sc = df.sparkSession.sparkContext
    blocks = [sc.broadcast([(r["r"], list(r["n"])) for r in part(i).orderBy("r").collect()]) for i in range(n_blocks)]
    rows = df.select(df[key].alias("k"), F.coalesce(df[value], F.lit("")).alias("v"))
    if not blanks:
        rows = rows.filter(F.col("v").rlike(r"[^\s\p{Z}]"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, done = Matcher(blocks[0].value), {}
        for b in batches:
            take, refs = [], []
            for i, v in enumerate(b.column(1).to_pylist()):
                if v not in done:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done[v] = sorted({r for n in matcher.chosen(matcher.stretches(v, title), several) for r in matcher.of[n]}) or [0]
                take += [i] * len(done[v])
                refs += done[v]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), pa.array(refs, pa.int64())], ["k", "r"])

    if len(blocks) == 1:
        return rows.mapInArrow(one, f"k {kind}, r long").select(F.col("k").alias(key), F.col("r").alias(ref_key))
    # Each block gives its stretches of every distinct value; a value's stretches are few and come together by value.
    values, parts = rows.select("v").distinct(), None
    for some in blocks:

        def part(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(some.value)
            for b in batches:
                got = [(v, *x, r) for v in b.column(0).to_pylist() for x in matcher.stretches(v, title) for r in sorted(matcher.of[x[4]])]
                yield pa.RecordBatch.from_pylist([dict(zip(("v", "score", "i", "j", "d", "n", "r"), x)) for x in got], pa.schema([("v", pa.string()), ("score", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("d", pa.int32()), ("n", pa.string()), ("r", pa.int64())]))

        got = values.mapInArrow(part, "v string, score int, i int, j int, d int, n string, r long")
        parts = got if parts is None else parts.unionByName(got)

    def winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                found = [(x["score"], x["i"], x["j"], x["d"], x["n"]) for x in row["x"]]
                names = set(Matcher.chosen(found, several))
                out += [{"v": row["v"], "r": r} for r in sorted({x["r"] for x in row["x"] if x["n"] in names})]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("v", pa.string()), ("r", pa.int64())]))

    won = parts.groupBy("v").agg(F.collect_set(F.struct("score", "i", "j", "d", "n", "r")).alias("x")).mapInArrow(winners, "v string, r long")
    return rows.join(won, "v", "left").select(F.col("k").alias(key), F.coalesce("r", F.lit(0)).alias(ref_key))
