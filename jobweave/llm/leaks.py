"""Documents that hold passages of held-out evaluation items.

The items' normalised word n-grams are a hash set that is broadcast, once its size is checked. Every document's token windows are
looked up in it; places where several grams of an item lie along one diagonal are verified by a local alignment of the words. Spans so
found can be cut out in the same pass. No shuffle: documents stay where they were read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm import folding
from jobweave.llm.common import spread

GRAM = 3  # words; where every fourth word is changed, three between them still stand
UNDER = 0.25  # the item's words under grams along a diagonal, as a share, from which a place is verified: half the item with every fourth word changed has 0.37
EDGE = 2  # words changed at a passage's ends that the alignment cannot see
BROADCAST_CHARS = 32 << 20  # of items under one broadcast, which has some eight times as many bytes; more are taken in parts


def words(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end): the words of `folding.words` with their places in the text as it is."""
    if not text:
        return []
    plain = folding.blanked(text)
    out, where = [], []
    for i, c in enumerate(plain):
        if c < "\x80":
            out.append(c)
            where.append(i)
            continue
        for d in unicodedata.normalize("NFKD", c).translate(folding.LIKE):
            if not folding.unseen(d):
                out.append(d)
                where.append(i)
    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in out)
    return [(m.group().lower(), where[m.start()], where[m.end() - 1] + 1) for m in folding.WORD.finditer(low)]


def align(a: np.ndarray, b: np.ndarray, miss: int = 2) -> tuple[int, int, int, int, int]:
    """The best local alignment: a match counts 1, a word changed, left out or put in -miss.

    Gives the first and last place (exclusive) in a and in b, and the number of matches.
    """
    n, m = len(a), len(b)
    pair = np.where(a[:, None] == b, np.int32(1), np.int32(-miss))
    h = np.zeros((n + 1, m + 1), np.int32)
    step, gap = miss * np.arange(m + 1, dtype=np.int32), np.empty(m, np.int32)
    for before, row, one in zip(h, h[1:], pair):
        inner = row[1:]
        np.add(before[:-1], one, out=inner)
        np.subtract(before[1:], miss, out=gap)
        np.maximum(inner, gap, out=inner)
        np.maximum(row, 0, out=row)
        row += step
        np.maximum.accumulate(row, out=row)
        row -= step
    i, j = map(int, np.unravel_index(int(h.argmax()), h.shape))
    end_a, end_b, same = i, j, 0
    while h[i, j] > 0:
        if i and j and h[i, j] == h[i - 1, j - 1] + pair[i - 1, j - 1]:
            same += int(pair[i - 1, j - 1] > 0)
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] - miss:
            i -= 1
        else:
            j -= 1
    return i, end_a, j, end_b, same


def _window(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words at the places; those of different lengths differ."""
    g = np.full(len(at), n, np.uint64)
    for k in range(n):
        g = (g * np.uint64(0x9E3779B97F4A7C15)) ^ (w[at + k].astype(np.uint64) + np.uint64(1))
        g ^= g >> np.uint64(29)
    return g.view(np.int64)


def grams(w: np.ndarray) -> np.ndarray:
    """Hashes of the windows of GRAM words; of a shorter text one of all."""
    return _window(w, np.arange(max(1, len(w) - GRAM + 1)), min(GRAM, len(w)))


def _dense(a: np.ndarray, w: np.ndarray, first: int, width: int, share: float, same: float) -> bool:
    """Whether some stretch of a, as long as a passage must be, has `same` of its words near their diagonals in w: first to first + width."""
    j = np.arange(len(a))[:, None] + np.arange(first, first + width + 1)
    inside = (j >= 0) & (j < len(w))
    near = ((w[np.clip(j, 0, len(w) - 1)] == a[:, None]) & inside).any(1)
    n = max(1, int(np.ceil(share * len(a))) - EDGE)
    upto = np.append(0, np.cumsum(near))
    return int((upto[n:] - upto[:-n]).max()) >= same * n - 1


class Index:
    """The items' words as numbers, and a hash set of their n-grams: slots by a gram's lowest bits, in each the gram and where its places begin."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.number: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        keys, of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in folding.words(text or "")], np.int64)
            if not len(w):
                continue
            g = grams(w)
            keys.append(g)
            of.append(np.full(len(g), len(self.items), np.int32))
            at.append(np.arange(len(g), dtype=np.int32))
            self.items.append((item, w))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        self.of, self.at = np.concatenate(of)[order], np.concatenate(at)[order]
        kinds, first, n = np.unique(key[order], return_index=True, return_counts=True)
        self.slots = 1 << max(4, int(4 * len(kinds)).bit_length())
        self.key, self.first, self.n = np.zeros(self.slots, np.int64), np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        left = np.arange(len(kinds))
        step = 0
        while len(left):  # linear probing, all that are left at once
            slot = (kinds[left] + step) & (self.slots - 1)
            free = np.flatnonzero(self.n[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.key[slot[put]], self.first[slot[put]], self.n[slot[put]] = kinds[left[put]], first[left[put]], n[left[put]]
            left = np.delete(left, put)
            step += 1
        self.steps = step
        size = np.array([len(a) for _, a in self.items], np.int64)
        self.slack, self.short = 3 + size // 6, bool((size < GRAM).any())
        self.under = np.where(size < GRAM, 1, UNDER * size)

    def looked_up(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the places of each gram begin, how many there are)."""
        first, n, open_ = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), np.arange(len(g))
        for step in range(self.steps):
            slot = (g[open_] + step) & (self.slots - 1)
            used = self.n[slot] > 0
            open_, slot = open_[used], slot[used]
            hit = self.key[slot] == g[open_]
            first[open_[hit]], n[open_[hit]] = self.first[slot[hit]], self.n[slot[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return first, n

    def found(self, documents: list[np.ndarray], share: float, same: float) -> list[list[tuple[int, int, int]]]:
        """For each document (item, first word, last word exclusive) of the passages in its words, a number each, 0 for one that no item has."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
        if not documents or not self.items:
            return out
        # All documents one after the other, so far apart that no window spans two.
        size = np.array([len(d) for d in documents], np.int64)
        begin = np.cumsum(size + GRAM) - (size + GRAM)
        w = np.zeros(int((size + GRAM).sum()), np.int64)
        for d, at in zip(documents, begin.tolist()):
            w[at : at + len(d)] = d
        g = grams(w)
        known = w > 0
        for k in range(1, GRAM):
            known[: len(g)] &= w[k : k + len(g)] > 0
        at = np.flatnonzero(known[: len(g)])  # windows of words that stand in some item
        key = g[at]
        if self.short:  # items under GRAM words are windows of their own
            for n in range(1, GRAM):
                some = np.flatnonzero(w[: len(w) - n + 1] > 0)
                at, key = np.append(at, some), np.append(key, _window(w, some, n))
        lo, n = self.looked_up(key)
        hit = np.flatnonzero(n)
        if not len(hit):
            return out
        n = n[hit]
        pos = np.repeat(at[hit], n)
        k = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[hit], n)
        of, word, diagonal = self.of[k].astype(np.int64), self.at[k], pos - self.at[k]
        # Diagonals in strips as wide as the slack of a passage, which so lies within two of them. Two that cover too few words are out at once.
        doc = np.searchsorted(begin, pos, "right") - 1
        strip = (diagonal - begin[doc]) // self.slack[of]
        low = int(strip.min())
        wide = int(strip.max()) - low + 4
        key = (doc * len(self.items) + of) * wide + (strip - low)
        order = np.lexsort((word, key))
        key, word = key[order], word[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        gap = np.full(len(key), GRAM)
        gap[1:] = np.where(new[1:], GRAM, np.minimum(word[1:] - word[:-1], GRAM))
        under, key = np.add.reduceat(gap, np.flatnonzero(new)), key[new]
        upto = np.append(0, np.cumsum(under))
        both = upto[np.searchsorted(key, key + 1, "right")] - upto[:-1]
        owner, at_strip = key // wide, key % wide + low
        item = owner % len(self.items)
        good = np.flatnonzero(both >= self.under[item])
        tried: dict[int, list[int]] = {}
        places: dict[int, list[tuple[int, int, int]]] = {}
        for x in good[np.argsort(-both[good], kind="stable")].tolist():
            o, s = int(owner[x]), int(at_strip[x])
            if any(abs(s - t) <= 1 for t in tried.get(o, ())):
                continue
            tried.setdefault(o, []).append(s)
            a, text, slack = self.items[int(item[x])][1], documents[o // len(self.items)], int(self.slack[item[x]])
            if not _dense(a, text, s * slack, 2 * slack, share, same):
                continue
            left, right = max(0, s * slack), min(len(text), (s + 2) * slack + len(a))
            i0, i1, j0, j1, n_same = align(a, text[left:right])
            if i1 - i0 + EDGE * (i1 > i0) >= share * len(a) and n_same >= min(GRAM, len(a)) and n_same >= same * (i1 - i0):
                places.setdefault(o, []).append((n_same, left + j0, left + j1))
        for o, those in places.items():
            # Of places that overlap the one with most matches counts.
            taken: list[tuple[int, int]] = []
            for _, x, y in sorted(those, key=lambda p: -p[0]):
                if all(y <= u or x >= v for u, v in taken):
                    taken.append((x, y))
                    out[o // len(self.items)].append((self.items[o % len(self.items)][0], x, y))
        return out


def _scanned(documents: DataFrame, items: DataFrame, text: str, item_key: str, share: float, same: float) -> Iterator[Callable]:
    """For each part of the items a function that gives the passages of each of several texts: (item, first, last)."""
    sc = documents.sparkSession.sparkContext
    rows = items.select(items[item_key].cast("long").alias("i"), items[text].cast("string").alias("t")).dropna().distinct()
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-chars // BROADCAST_CHARS)
    for part in range(parts):
        some = rows.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == part) if parts > 1 else rows
        index = sc.broadcast(Index([tuple(r) for r in some.orderBy("i", "t").collect()]))  # BROADCAST_CHARS at most, or little more

        def passages(texts: list[str | None], index=index) -> Iterator[list[tuple[int, int, int]]]:
            x = index.value
            get = x.number.get
            for k in range(0, len(texts), 256):
                some = texts[k : k + 256]
                for t, hits in zip(some, x.found([np.array([get(w, 0) for w in folding.words(t)] if t else [], np.int64) for t in some], share, same)):
                    at = words(t) if hits else []
                    yield [(item, at[a][1], at[b - 1][2]) for item, a, b in hits]

        yield passages


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", share: float = 0.5, same: float = 0.7) -> DataFrame:
    """Rows (doc_key, item_key, first, last): the characters of the document's text that hold at least `share` of the item; a row for each such place.

    A passage counts when `same` of its words are the item's, in order. Null, empty and blank texts hold nothing; an
    item under GRAM words is found by its whole; repeated items and documents give each place once; other columns are not read.
    Either table empty gives an empty result. Items of more than BROADCAST_CHARS are taken in parts, a pass over the documents each.
    """
    kind = dict(documents.dtypes)[doc_key]
    schema = f"d {kind}, i long, first int, last int"
    at = spread(documents.filter(F.length(documents[text]) > 0).select(documents[doc_key].alias("d"), documents[text].cast("string").alias("t")))
    result = documents.sparkSession.createDataFrame([], schema)
    for passages in _scanned(documents, items, text, item_key, share, same):

        def scan(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(r, *x) for r, found in enumerate(passages(b.column(1).to_pylist())) for x in found]
                row, item, first, last = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["d", "i", "first", "last"])

        result = result.unionByName(at.mapInArrow(scan, schema))
    return result.distinct().select(F.col("d").alias(doc_key), F.col("i").alias(item_key), "first", "last")


def removed(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", share: float = 0.5, same: float = 0.7) -> DataFrame:
    """(doc_key, text, spans): every document, with all leaked passages cut out of its text, and how many stretches that were.

    Rows come out as often as they went in; a null text stays null. Scanned and cut in one pass, without a join.
    """
    kind = dict(documents.dtypes)[doc_key]
    result = spread(documents.select(documents[doc_key].alias("d"), documents[text].cast("string").alias("t"), F.lit(0).alias("spans")))
    for passages in _scanned(documents, items, text, item_key, share, same):

        def scan(batches: Iterator[pa.RecordBatch], passages=passages) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, spans = b.column(1).to_pylist(), b.column(2).to_pylist()
                for r, found in enumerate(passages(b.column(1).to_pylist())):
                    out, upto = [], 0
                    for first, last in sorted((a, z) for _, a, z in found):
                        if first >= upto:
                            out.append(texts[r][upto:first])
                            spans[r] += 1
                        upto = max(upto, last)
                    if upto:
                        texts[r] = "".join([*out, texts[r][upto:]])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.int32())], ["d", "t", "spans"])

        result = result.mapInArrow(scan, f"d {kind}, t string, spans int")
    return result.select(F.col("d").alias(doc_key), F.col("t").alias(text), "spans")


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the leaked spans cut out of their text, in the original columns; documents without leaks as they are."""
    spans = leaks.groupBy(doc_key).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"))
    keep = F.aggregate(
        "_spans",
        F.struct(F.lit("").alias("s"), F.lit(0).alias("at")),
        lambda a, x: F.struct(F.concat(a["s"], F.when(x["first"] > a["at"], F.substring(F.col(text), a["at"] + 1, x["first"] - a["at"])).otherwise("")).alias("s"), F.greatest(a["at"], x["last"]).alias("at")),
        lambda a: F.concat(a["s"], F.substring(F.col(text), a["at"] + 1, F.lit(2147483647) - a["at"])),
    )
    return documents.join(spans, doc_key, "left").withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(keep)).drop("_spans")
