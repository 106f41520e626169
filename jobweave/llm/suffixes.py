"""Suffix arrays over concatenated texts, in files of a shared folder that never change once written.

Texts lie one after the other in text files. A suffix array holds suffixes at sampled word starts of such texts, in order: the
first HEAD bytes of each, once, and for each of these the places in the text files. Which places are sampled depends on the
suffix's own bytes, so equal suffixes are sampled alike wherever they stand. A large array is several files, each a range of the order.

A text's own suffixes are binary-searched in the arrays; each hit is extended to both sides as far as the texts agree, and what the
matches cover is summed for each pair of texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np

HEAD = 32  # bytes by which suffixes are ordered, and the least a match must have
RATE = 8  # one in so many word starts is sampled
LEAST = 8  # places sampled of every text at least, if it has so many
SHARE = 0.4  # share of a text's sampled suffixes that another must hold to be compared with it
SPARED = 0.2  # share of them, the most frequent ones, whose places need not be gone through for that
AT_ONCE = 2_000_000  # hits handled at once
OFFSET = 32  # bits of a place within its text file

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def mounted(path: str) -> str | None:
    """The path on a mounted file system, or null."""
    return path[5:].replace("//", "/", 1) if path.startswith("file:") else path if ":" not in path.split("/")[0] else None


def opened(path: str, kind) -> np.ndarray:
    """The file as an array; of a mounted file only the pages looked at are read."""
    if (p := mounted(path)) is not None:
        with open(p, "rb") as f:
            return np.memmap(f, kind, "r") if f.seek(0, 2) else np.zeros(0, kind)
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_input_file(p) as f:
        return np.frombuffer(f.read(), kind)


def written(path: str, data: np.ndarray) -> None:
    if (p := mounted(path)) is not None:
        data.tofile(p)
        return
    from pyarrow import fs

    system, p = fs.FileSystem.from_uri(path)
    with system.open_output_stream(p) as f:
        f.write(np.ascontiguousarray(data).data)


@dataclass
class Texts:
    """Texts' bytes with a blank after each; starts has one place more than there are texts."""

    raw: np.ndarray
    starts: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(ids, texts: list[bytes]) -> Texts:
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        return Texts(np.frombuffer(b" ".join([*texts, b""]), np.uint8), np.append(0, np.cumsum(sizes)), np.array(ids, np.int64))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts) - 1

    def write(self, path: str) -> None:
        for end, data in (("text", self.raw), ("starts", self.starts), ("ids", self.ids)):
            written(f"{path}.{end}", data)

    @staticmethod
    def open(path: str) -> Texts:
        return Texts(opened(f"{path}.text", np.uint8), opened(f"{path}.starts", np.int64), opened(f"{path}.ids", np.int64))


class Library:
    """The text files by number, opened when first needed."""

    def __init__(self, paths: dict[int, str]):
        self.paths, self.held = paths, {}

    def __getitem__(self, n: int) -> Texts:
        if n not in self.held:
            self.held[n] = Texts.open(self.paths[n])
        return self.held[n]

    def text_at(self, place: int) -> bytes:
        """The text that begins at the place."""
        t, at = self[place >> OFFSET], place & ((1 << OFFSET) - 1)
        return t.raw[at : t.starts[np.searchsorted(t.starts, at, "right")] - 1].tobytes()

    def read(self, places: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        return [self[p >> OFFSET].raw[p & ((1 << OFFSET) - 1) :][:n].tobytes() for p, n in zip(places.tolist(), sizes.tolist())]


def word_starts(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every word or East Asian character that HEAD bytes of the text begin with."""
    b = t.raw
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ones(len(b), bool)
    first[1:] = (b[:-1] == 32) | (b[1:] >= 0xE3)
    at = np.flatnonzero(first & (b != 32) & ((b & 0xC0) != 0x80))
    doc = np.searchsorted(t.starts, at, "right") - 1
    ok = at + HEAD <= t.starts[doc + 1] - 1
    return at[ok], doc[ok]


def heads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, f"S{HEAD}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, HEAD)[at]).view(f"S{HEAD}").ravel()


def hashed(head: np.ndarray) -> np.ndarray:
    words = head.view(np.uint64).reshape(-1, HEAD // 8)
    h = np.zeros(len(head), np.uint64)
    for k in range(HEAD // 8):
        h = (h ^ words[:, k]) * _B
        h ^= h >> np.uint64(29)
    h = h * _A
    return h ^ (h >> np.uint64(32))


def sampled(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, text, head) of the sampled suffixes: those whose head's hash is among the lowest of all, one in RATE, or the LEAST lowest of the text."""
    at, doc = word_starts(t)
    head = heads(t.raw, at)
    h = hashed(head)
    take = h < np.uint64(2**64 // RATE)
    few = np.flatnonzero(np.bincount(doc[take], minlength=len(t.ids))[doc] < LEAST)
    order = few[np.lexsort((h[few], doc[few]))]
    d = doc[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d, "left")
    take[order[rank < LEAST]] = True
    return at[take], doc[take], head[take]


@dataclass
class Array:
    """Sorted heads, and the places of each in `places[ends[i]:ends[i + 1]]`."""

    heads: np.ndarray
    ends: np.ndarray
    places: np.ndarray

    @staticmethod
    def of(head: np.ndarray, place: np.ndarray) -> Array:
        order = np.lexsort((place, head))
        head, place = head[order], place[order]
        new = np.ones(len(head), bool)
        new[1:] = head[1:] != head[:-1]
        return Array(head[new], np.append(np.flatnonzero(new), len(head)), place)

    def __len__(self) -> int:
        return len(self.places)

    def write(self, path: str) -> None:
        for end, data in (("heads", self.heads), ("ends", self.ends), ("places", self.places)):
            written(f"{path}.{end}", data)

    @staticmethod
    def open(path: str, kind: str = f"S{HEAD}") -> Array:
        return Array(opened(f"{path}.heads", kind), opened(f"{path}.ends", np.int64), opened(f"{path}.places", np.int64))

    def between(self, low, high) -> tuple[np.ndarray, np.ndarray]:
        """(head, place) of the suffixes from low (included) to high; null for no bound."""
        i = 0 if low is None else int(np.searchsorted(self.heads, low, "left"))
        j = len(self.heads) if high is None else int(np.searchsorted(self.heads, high, "left"))
        ends = np.asarray(self.ends[i : j + 1])
        return np.repeat(self.heads[i:j], np.diff(ends)), np.asarray(self.places[ends[0] : ends[-1]]) if j > i else np.zeros(0, np.int64)


@dataclass
class Hits:
    """Lookups of sorted heads in one array."""

    places: np.ndarray
    low: np.ndarray
    n: np.ndarray


def looked_up(array: Array, asked: np.ndarray) -> Hits:
    """Where each of the sorted heads stands in the array, by binary search."""
    at = np.searchsorted(array.heads, asked, "left")
    inside = at < len(array.heads)
    hit = np.flatnonzero(inside)
    hit = hit[array.heads[at[hit]] == asked[hit]]
    low, n = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    low[hit] = array.ends[at[hit]]
    n[hit] = array.ends[at[hit] + 1] - low[hit]
    return Hits(array.places, low, n)


@dataclass
class Found:
    """Pairs of an asked text and an earlier one, where that begins, and the share of both that matches cover."""

    asked: list = field(default_factory=list)
    other: list = field(default_factory=list)
    places: list = field(default_factory=list)
    covered: list = field(default_factory=list)


def search(asked: Texts, arrays: list[Array], library: Library, least: float) -> Found:
    """Earlier texts (of a lower id) in the arrays that matches cover together with the asked texts for at least about `least` of both.

    Every text gives its sampled suffixes. One that shares SHARE of them shares SHARE - SPARED of those left when the SPARED most frequent
    are set aside, so only the places of these are gone through.
    """
    out = Found()
    at, doc, head = sampled(asked)
    if not len(at) or not arrays:
        return out
    kinds, of = np.unique(head, return_inverse=True)
    looks = [looked_up(a, kinds) for a in arrays]
    often = np.sum([x.n for x in looks], axis=0)
    n_of = np.bincount(doc, minlength=len(asked.ids))
    spared = np.floor(n_of * SPARED).astype(np.int64)
    order = np.lexsort((at, -often[of], doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order], "left")
    seeds = np.sort(order[(rank >= spared[doc[order]]) & (often[of[order]] > 0)])
    need = np.maximum(1, np.ceil(n_of * SHARE - 1e-9).astype(np.int64) - spared)
    load = np.cumsum(often[of[seeds]])
    k = 0
    while k < len(seeds):  # whole texts, so many that their hits fit
        end = int(np.searchsorted(load, (load[k - 1] if k else 0) + AT_ONCE, "right"))
        end = max(k + 1, end)
        end = int(np.searchsorted(doc[seeds], doc[seeds[end]], "left")) if end < len(seeds) else end
        if end <= k:
            end = int(np.searchsorted(doc[seeds], doc[seeds[k]], "right"))
        _some(asked, seeds[k:end], at, doc, of, looks, library, need, least, out)
        k = end
    return out


def _some(asked: Texts, seeds: np.ndarray, at, doc, of, looks: list[Hits], library: Library, need: np.ndarray, least: float, out: Found) -> None:
    seed, place = [], []
    for x in looks:
        n = x.n[of[seeds]]
        m = np.flatnonzero(n)
        r = np.repeat(m, n[m])
        low = x.low[of[seeds[m]]]
        place.append(x.places[np.arange(len(r)) - np.repeat(np.cumsum(n[m]) - n[m], n[m]) + np.repeat(low, n[m])])
        seed.append(seeds[r])
    seed, place = np.concatenate(seed), np.concatenate(place)
    number, offset = place >> OFFSET, place & ((1 << OFFSET) - 1)
    mine = asked.sizes
    keep_seed, keep_rec, keep_off, keep_no = [], [], [], []
    for no in np.unique(number).tolist():
        m = number == no
        t, s, p = library[no], seed[m], offset[m]
        rec = np.searchsorted(t.starts, p, "right") - 1
        size = np.asarray(t.starts[rec + 1]) - np.asarray(t.starts[rec]) - 1
        d = doc[s]
        ok = (np.asarray(t.ids[rec]) < asked.ids[d]) & (2 * np.minimum(size, mine[d]) >= least * (size + mine[d]))
        keep_seed.append(s[ok])
        keep_rec.append(rec[ok])
        keep_off.append(p[ok])
        keep_no.append(np.full(int(ok.sum()), no))
    if not keep_seed:
        return
    seed, rec, offset, number = (np.concatenate(x) for x in (keep_seed, keep_rec, keep_off, keep_no))
    if not len(seed):
        return
    others, other = np.unique((number << OFFSET) | rec, return_inverse=True)
    kinds, pair, k = np.unique(doc[seed] * len(others) + other, return_inverse=True, return_counts=True)
    pairs = np.stack([kinds // len(others), others[kinds % len(others)]], 1)
    good = k >= need[pairs[:, 0]]
    m = good[pair]
    if not m.any():
        return
    pair, seed, offset = pair[m], seed[m], offset[m]
    covered = np.zeros(len(pairs), np.int64)
    size = np.ones(len(pairs), np.int64)
    for no in np.unique(number[m]).tolist():
        here = number[m] == no
        t = library[no]
        p, x, y = pair[here], at[seed[here]], offset[here]
        d, r = pairs[p, 0], pairs[p, 1] & ((1 << OFFSET) - 1)
        a, b, c, e = extended(asked.raw, t.raw, p, x, y, asked.starts[d], asked.starts[d + 1] - 1, np.asarray(t.starts[r]), np.asarray(t.starts[r + 1]) - 1)
        covered += union(a, b, c, len(pairs)) + union(a, e, c, len(pairs))
        size[p] = mine[d] + np.asarray(t.starts[r + 1]) - np.asarray(t.starts[r]) - 1
    share = covered / size
    for i in np.flatnonzero(good & (share >= least)).tolist():
        no, r = int(pairs[i, 1]) >> OFFSET, int(pairs[i, 1]) & ((1 << OFFSET) - 1)
        out.asked.append(int(asked.ids[pairs[i, 0]]))
        out.other.append(int(library[no].ids[r]))
        out.places.append(no << OFFSET | int(library[no].starts[r]))
        out.covered.append(float(share[i]))


def extended(one: np.ndarray, two: np.ndarray, pair: np.ndarray, x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, first place in one, length, first place in two) of the longest matches around equal heads at x in one and y in two.

    x0 to x1 and y0 to y1 are the texts. Hits within a match already found on their diagonal aren't extended again.
    """
    order = np.lexsort((x, x - y, pair))
    pair, x, y, x0, x1, y0, y1 = (v[order] for v in (pair, x, y, x0, x1, y0, y1))
    line = np.zeros(len(x), np.int64)
    line[1:] = np.cumsum((pair[1:] != pair[:-1]) | ((x - y)[1:] != (x - y)[:-1]))
    todo, got = np.arange(len(x)), []
    while len(todo):
        lead = np.ones(len(todo), bool)
        lead[1:] = line[todo[1:]] != line[todo[:-1]]
        i = todo[lead]
        right = HEAD + _alike(one, two, x[i] + HEAD, y[i] + HEAD, np.minimum(x1[i] - x[i], y1[i] - y[i]) - HEAD, 1)
        left = _alike(one, two, x[i] - 1, y[i] - 1, np.minimum(x[i] - x0[i], y[i] - y0[i]), -1)
        got.append(np.stack([pair[i], x[i] - left, left + right, y[i] - left]))
        upto = np.zeros(int(line[-1]) + 1, np.int64)
        upto[line[i]] = x[i] + right
        todo = todo[x[todo] + HEAD > upto[line[todo]]]
    return tuple(np.concatenate(got, 1)) if got else tuple(np.zeros((4, 0), np.int64))


def _alike(one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many bytes from x and y on agree, at most `most`; way 1 to the right, -1 to the left."""
    n, step = np.zeros(len(x), np.int64), np.arange(64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        reach = n[open_, None] + step
        inside = reach < most[open_, None]
        u = np.clip(x[open_, None] + way * reach, 0, len(one) - 1)
        v = np.clip(y[open_, None] + way * reach, 0, len(two) - 1)
        same = inside & (one[u] == two[v])
        run = np.where(same.all(1), 64, np.argmin(same, 1))
        n[open_] += run
        open_ = open_[run == 64]
    return n


def union(pair: np.ndarray, first: np.ndarray, length: np.ndarray, n_pairs: int) -> np.ndarray:
    """Bytes under the intervals, for each pair."""
    order = np.lexsort((first, pair))
    p, a, b = pair[order], first[order], (first + length)[order]
    if not len(p):
        return np.zeros(n_pairs, np.int64)
    # Ends so far within the pair: offsets keep the pairs apart in one running maximum.
    shift = p * np.int64(1 << 40)
    reach = np.maximum.accumulate(b + shift)
    before = np.empty_like(reach)
    before[0], before[1:] = np.iinfo(np.int64).min, reach[:-1]
    return np.bincount(p, np.maximum(0, b + shift - np.maximum(a + shift, before)), n_pairs).astype(np.int64)


def exactly(one: bytes, two: bytes) -> float:
    """The share of both texts' bytes under the runs of HEAD bytes at word starts that the other has, too."""
    a, b = (Texts.of([0], [t]) for t in (one, two))
    (x, _), (y, _) = word_starts(a), word_starts(b)
    p, q = hashed(heads(a.raw, x)), hashed(heads(b.raw, y))
    held = [x[np.isin(p, q)], y[np.isin(q, p)]]
    under = sum(int(np.minimum(np.diff(v), HEAD).sum()) + HEAD for v in held if len(v))
    return under / max(1, len(one) + len(two))


def new_name(folder: str, kind: str) -> str:
    return f"{folder}/{kind}-{uuid.uuid4().hex}"
