"""Splitting of oversized texts at natural boundaries, by recursive bisection.

A text over the limit is cut at the strongest boundary near the middle of its tokens, and each half again while it
exceeds the limit less the overlap; then every piece but the first is given the last tokens of the one before it.
Rows are handled where they are read: no shuffle but the one that evens out the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import spread
from jobweave.llm.tokenizer import FOLDER, encoding

# Boundaries from the strongest to the weakest; each pattern ends where a cut may be made.
BOUNDARIES = [
    regex.compile(r"\n[ \t]*\n\s*(?=#)|\n(?=#{1,6} )"),
    regex.compile(r"\n[ \t\r]*\n+"),
    regex.compile(r"\n"),
    regex.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s)|[。！？]"),
    regex.compile(r"[;:；：](?=\s)|[、，；：]|[,–—](?=\s)"),
    regex.compile(r"(?<=\S)(?=\s)"),
]
NEAR = 0.25  # the middle's neighbourhood in which a stronger boundary is preferred, as a share of the length to each side


def levels(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (characters) where text may be cut, ascending, and the rank of each, 0 the strongest."""
    best: dict[int, int] = {}
    for rank, pattern in enumerate(BOUNDARIES):
        for m in pattern.finditer(text):
            at = m.end() if rank != 5 else m.start()
            if 0 < at < len(text):
                best.setdefault(at, rank)
    at = np.array(sorted(best), np.int64)
    return at, np.array([best[x] for x in at.tolist()], np.int8)


def split(text: str, limit: int, overlap: int, enc) -> list[tuple[int, int, int, int]]:
    """Pieces of text as (first character, end, tokens, characters shared with the piece before); whole if within the limit.

    No piece, encoded on its own, has more than limit tokens. Where a stretch has no boundary it is cut between
    two characters.
    """
    ids = enc.encode_ordinary(text)
    if len(ids) <= limit:
        return [(0, len(text), len(ids), 0)]
    sizes = np.array([len(enc.decode_single_token_bytes(t)) for t in ids], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # byte where each character begins
    byte_of = np.append(first, len(raw))
    tok_of = np.searchsorted(ends, byte_of, "right")  # tokens that end at or before each character's start
    clean = np.append(0, ends)[tok_of] == byte_of  # characters at which a token begins
    at, rank = levels(text)
    fit = clean[at]
    at, rank = at[fit], rank[fit]
    any_at = np.flatnonzero(clean)
    room = limit - overlap
    out: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        n = int(tok_of[hi] - tok_of[lo])
        if n <= room or hi - lo < 2:
            out.append((lo, hi))
            continue
        mid = (tok_of[lo] + tok_of[hi]) / 2
        cut = _cut(at, rank, tok_of, lo, hi, mid, NEAR * n)
        if cut is None or min(tok_of[cut] - tok_of[lo], tok_of[hi] - tok_of[cut]) < max(overlap, n // 8):
            free = any_at[np.searchsorted(any_at, lo, "right") : np.searchsorted(any_at, hi, "left")]
            cut = int(free[np.argmin(np.abs(tok_of[free] - mid))]) if len(free) else (lo + hi) // 2
        todo += [(cut, hi), (lo, cut)]
    pieces, k = [], 0
    while k < len(out):
        lo, hi = out[k]
        start = lo
        if k:
            start = _start(text, lo, max(0, int(np.searchsorted(tok_of[any_at], tok_of[lo] - overlap, "right")) - 1), any_at, overlap, enc)
            start = max(start, out[k - 1][0] if k == 1 else pieces[-1][0])
        n = len(enc.encode_ordinary(text[start:hi]))
        while n > limit and start < lo and k:  # cut off from their context, tokens may fall apart; the overlap gives way first
            start = min(lo, start + max(1, (lo - start) // 8))
            n = len(enc.encode_ordinary(text[start:hi]))
        if n > limit and hi - lo > 1:
            mid = (tok_of[lo] + tok_of[hi]) / 2
            cut = _cut(at, rank, tok_of, lo, hi, mid, NEAR * (tok_of[hi] - tok_of[lo])) or (lo + hi) // 2
            out[k : k + 1] = [(lo, cut), (cut, hi)]
            continue
        pieces.append((start, hi, n, lo - start))
        k += 1
    return pieces


def _start(text: str, lo: int, near: int, free: np.ndarray, overlap: int, enc) -> int:
    """Where the overlap before lo begins: of the places around the one with `overlap` tokens in the whole text, the first that leaves as many on its own.

    On its own a stretch may have a token less or more at either end. Where no place close by has just as many, the nearest count decides.
    """
    best = None
    for d in (0, -1, 1, -2, 2, -3, 3, -4, 4):
        if 0 <= near + d < len(free) and free[near + d] < lo:
            off = abs(len(enc.encode_ordinary(text[free[near + d] : lo])) - overlap)
            if best is None or off < best[0]:
                best = (off, int(free[near + d]))
            if not off:
                break
    return best[1] if best else int(free[near])


def _cut(at: np.ndarray, rank: np.ndarray, tok_of: np.ndarray, lo: int, hi: int, mid: float, near: float) -> int | None:
    """The strongest boundary within `near` tokens of mid, of equal ones the nearest; else the nearest boundary at all."""
    a, b = np.searchsorted(at, lo, "right"), np.searchsorted(at, hi, "left")
    if a >= b:
        return None
    place, far = at[a:b], np.abs(tok_of[at[a:b]] - mid)
    close = np.flatnonzero(far <= near)
    if len(close):
        return int(place[close[np.lexsort((far[close], rank[a:b][close]))[0]]])
    return int(place[np.argmin(far)])


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 64, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Rows (key, piece, first, end, n_tokens, shared, body) of the texts over `limit` tokens; none for the others.

    first and end are characters of the text, `shared` those that stand in the piece before too; the bodies without
    them, in the order of `piece`, make up the text. Null and empty texts are not over the limit; texts of any length
    are split whole; repeated rows come out as often as they went in; a null key stays null; other columns are not read.
    """
    kind = dict(df.dtypes)[key]
    # A token is a byte at least, so texts of no more bytes than the limit need no encoding.
    rows = spread(df.filter(F.octet_length(df[text]) > limit).select(df[key].alias("id"), df[text].alias("t")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for b in batches:
            take, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                parts = split(t, limit, overlap, enc)
                if len(parts) > 1:
                    take += [i] * len(parts)
                    out += [(k, *p, t[p[0] : p[1]]) for k, p in enumerate(parts)]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, pa.int32()) for c in columns[:5]], pa.array(columns[5], pa.string())], ["id", "piece", "first", "end", "n_tokens", "shared", "body"])

    return rows.mapInArrow(cut, f"id {kind}, piece int, first int, end int, n_tokens int, shared int, body string").withColumnRenamed("id", key)
