"""Token ids of a whole corpus; equal chunks of text are encoded once.

1. Each text is cut where a rolling hash over its bytes says so, so that equal passages give equal chunks wherever
   they stand. 2. Chunks are grouped by a 128-bit key (with partial aggregation); where a distinct chunk meets the documents
   that use it, it is encoded once. 3. The ids go back to the documents; each join between two chunks is repaired by encoding again
   from three pieces before it until the pieces of both sides agree. The result equals encoding the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import spread
from jobweave.llm.tokenizer import FOLDER, encoding, splitter

WINDOW = 16  # bytes under the rolling hash
BITS = 9  # a cut about every 2**BITS bytes
KEPT = 10_000  # chunks whose ids a task remembers
LEAST, MOST = 64, 8192  # bytes of a chunk; the last of a text may be shorter
_GEAR = np.random.default_rng(20250101).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Where raw's chunks end: after WINDOW bytes whose hash has BITS zero bits, between characters, LEAST to MOST apart."""
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h, k = _GEAR[b], 1
    while k < WINDOW:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    starts = np.ones(n + 1, bool)
    starts[:n] = (b & 0xC0) != 0x80
    marks = np.flatnonzero((h >> np.uint32(32 - BITS)) == 0) + 1
    ends, last = [], 0
    for m in [*marks[starts[marks]].tolist(), n]:
        while m - last > MOST:
            at = last + MOST
            while not starts[at]:
                at -= 1
            ends.append(at)
            last = at
        if m - last >= LEAST or m == n and m > last:
            ends.append(m)
            last = m
    return ends


def _pieces(text: str) -> list[str]:
    return splitter().findall(text)


_START = re.compile(r"(?<=\S) (?=[^\W\d_])")


def _last_pieces(text: str) -> list[str]:
    """The last three pieces of text. A piece always begins at a single blank before a letter, so the end alone is split where there is one."""
    end = text[-112:]
    if len(end) < len(text) and (m := _START.search(end)):
        found = _pieces(end[m.start() :])
        if len(found) > 3:
            return found[-3:]
    return _pieces(text)[-3:]


class _Ids:
    """Ids in parts, of which the last ones can be taken back."""

    def __init__(self):
        self.parts: list = []

    def add(self, ids) -> None:
        if len(ids):
            self.parts.append(ids)

    def drop(self, n: int) -> None:
        while n:
            last = self.parts.pop()
            if len(last) > n:
                self.parts.append(last[: len(last) - n])
                return
            n -= len(last)


def joined(parts: list[tuple[str, list[int], int, int]], enc) -> list:
    """The ids, in parts, of the concatenated texts of `parts`: (text, its ids, characters and ids of its last three pieces).

    Appending text can change no more than the last two pieces of what stands before it, so three are taken back;
    once a piece ends at the same place for both sides, all that follows is the same.
    """
    ids = _Ids()
    tail, tail_n = "", 0
    for k, (text, own, tail_chars, own_tail_n) in enumerate(parts):
        if not k:
            ids.add(own)
            tail, tail_n = text[len(text) - tail_chars :], own_tail_n
            continue
        n, sync, head, found = min(64, len(text)), None, 0, []
        while True:
            whole = n == len(text)
            at, ends = -len(tail), set()
            found = _pieces(tail + text[:n])
            for p in found if whole else found[:-3]:
                at += len(p)
                ends.add(at)
            at, right = 0, _pieces(text[:n])
            for i, p in enumerate(["", *(right if whole else right[:-3])]):
                at += len(p)
                if at in ends:
                    sync, head = at, sum(len(enc.encode_ordinary(x)) for x in right[:i])
                    break
            if sync is not None or whole:
                break
            n = min(len(text), 2 * n)
        ids.drop(tail_n)
        if sync is None or sync > len(text) - tail_chars or tail_chars == len(text):  # too short to stand alone
            seen = _pieces(tail + text)
            each = [enc.encode_ordinary(p) for p in seen]
            ids.add([x for e in each for x in e])
            tail, tail_n = "".join(seen[-3:]), sum(map(len, each[-3:]))
            continue
        at, between = -len(tail), []
        for p in found:
            if at >= sync:
                break
            between += enc.encode_ordinary(p)
            at += len(p)
        ids.add(between)
        ids.add(own[head:])
        tail, tail_n = text[len(text) - tail_chars :], own_tail_n
    return ids.parts


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Rows (key, ids) for every row of df: the ids of its text without special tokens.

    Null and empty texts give an empty list; a null key stays null; repeated rows come out as often as they went in;
    texts of any length are encoded whole; other columns are not read. An empty table gives an empty result.
    """
    kind = dict(df.dtypes)[key]
    rows = df.select(df[key].alias("id"), df[text].alias("t"))

    def chunks(batches: Iterator[pa.RecordBatch], bodies: bool) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, docs, seqs, keys, texts = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                raw = (t or "").encode()
                doc, last = xxhash.xxh3_64_intdigest(raw) - (1 << 63), 0
                if bodies:
                    for e in cuts(raw):
                        keys.append(xxhash.xxh3_128_digest(raw[last:e]))
                        texts.append(raw[last:e].decode())
                        last = e
                    continue
                ends = cuts(raw)
                for k, e in enumerate(ends or [0]):
                    ids.append(i)
                    docs.append(doc)
                    seqs.append(k if ends else -1)
                    keys.append(xxhash.xxh3_128_digest(raw[last:e]) if ends else xxhash.xxh3_128_digest(b"%d" % i))
                    last = e
                if len(keys) > 200_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array(docs, pa.int64()), pa.array(seqs, pa.int32()), pa.array(keys, pa.binary())], ["id", "doc", "seq", "k"])
                    ids, docs, seqs, keys = [], [], [], []
            if bodies:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(texts, pa.string())], ["k", "body"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(docs, pa.int64()), pa.array(seqs, pa.int32()), pa.array(keys, pa.binary())], ["id", "doc", "seq", "k"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        kind = np.uint16 if enc.max_token_value < 1 << 16 else np.uint32
        known: dict[bytes, tuple[bytes, int, int]] = {}
        for b in batches:
            out = []
            for k, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                if k not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    last = _last_pieces(t or "")
                    known[k] = np.array(enc.encode_ordinary(t or ""), kind).tobytes(), sum(map(len, last)), sum(len(enc.encode_ordinary(p)) for p in last)
                out.append(known[k])
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["id", "doc", "seq", "own", "tail_chars", "tail_n"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        kind = np.uint16 if enc.max_token_value < 1 << 16 else np.uint32
        for b in batches:
            take, out, sizes = [], [], [0]
            for i, parts in enumerate(b.column(1).to_pylist()):
                by: dict[int, list] = {}
                for p in parts:
                    by.setdefault(p["seq"], []).append(p)
                ids: list = []
                if -1 not in by:
                    one = [by[s][0] for s in sorted(by)]
                    own = [np.frombuffer(p["own"], kind) for p in one]
                    # The chunks' texts are their ids' bytes, so they needn't be sent along.
                    ids = own if len(own) == 1 else joined([(enc.decode_bytes(x.tolist()).decode(), x, p["tail_chars"], p["tail_n"]) for x, p in zip(own, one)], enc)
                size = sum(map(len, ids))
                for _ in by[min(by)]:  # as often as the row was there
                    take.append(i)
                    out += ids
                    sizes.append(size)
            flat = np.concatenate([np.asarray(x, np.int32) for x in out]) if out else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), lists], ["id", "ids"])

    where = spread(rows)
    refs = where.mapInArrow(lambda x: chunks(x, False), f"id {kind}, doc long, seq int, k binary")
    bodies = where.mapInArrow(lambda x: chunks(x, True), "k binary, body string").groupBy("k").agg(F.first("body").alias("body"))
    # The join brings the uses of a chunk together in one task, one after the other, where it is encoded once for all of them.
    coded = refs.join(bodies, "k", "left").select("id", "doc", "seq", "k", "body").mapInArrow(encode, f"id {kind}, doc long, seq int, own binary, tail_chars int, tail_n int")
    parts = coded.groupBy("id", "doc").agg(F.collect_list(F.struct("seq", "own", "tail_chars", "tail_n")).alias("parts"))
    return parts.select("id", "parts").mapInArrow(repair, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def decoded(df: DataFrame, key: str, ids: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, decoded): the texts that the ids stand for; an empty text for an empty or null list."""
    kind = dict(df.dtypes)[key]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["k", "decoded"])

    return df.select(df[key].alias("k"), df[ids]).mapInArrow(back, f"k {kind}, decoded string").withColumnRenamed("k", key)
