"""Languages of documents and of their stretches, by a bidirectional gated recurrent network over bytes.

The network reads a line's bytes, four at a step, forwards and backwards, labels every position and pools the
probabilities per line and per document. It is trained here, in numpy, by backpropagation through time on a bounded
sample of lines of documents with a declared label; labels may be wrong in part. All texts are then labelled whole where
they are read: no shuffle. Equal lines of a task's rows are read once.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import spread



LANGS = ["en", "vi", "fr", "de", "ja"]
# Fixed value: how a language may be written in a label, in lower case; a tag's region is left off beforehand.
SPELLINGS = {
    "en": "en eng english anglais englisch inglés tiếng anh 英語",
    "vi": "vi vie vietnamese vietnamien vietnamesisch vn tiếng việt tieng viet ベトナム語",
    "fr": "fr fra fre french français francais französisch tiếng pháp フランス語",
    "de": "de deu ger german deutsch allemand tiếng đức ドイツ語",
    "ja": "ja jpn jp japanese japonais japanisch tiếng nhật 日本語 にほんご",
}
_NAMES = {"tiếng anh": "en", "tiếng việt": "vi", "tieng viet": "vi", "tiếng pháp": "fr", "tiếng đức": "de", "tiếng nhật": "ja"}
PER_LANGUAGE = 500  # documents of each declared language in the sample: the bound on what is fitted on
LINES = 2000  # of these documents' lines, for each language
STEP, EMBED, HIDDEN = 4, 8, 24
LINE = 1024  # bytes of a line read at once; a longer one is read in parts
BESIDE = 0.005  # weight of a line's own probabilities where the document's other lines speak against them
LEAST_CHARS = 60  # characters in sentences from which a document has a language

_EAST = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_TAG = re.compile(r"<[^<>\n]{1,120}>|&[A-Za-z]{2,8};|https?://\S+")
_UNSEEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def declared(label: str | None) -> str | None:
    """The language a label means: a code of LANGS; None for a missing label; else the label itself in lower case."""
    s = unicodedata.normalize("NFKC", label or "").strip().lower()
    if s in ("", "und", "unknown", "null", "none", "n/a", "mul", "zxx"):
        return None
    if s in _NAMES:
        return _NAMES[s]
    for name in (s, re.split(r"[-_ (]", s)[0]):
        for code, words in SPELLINGS.items():
            if name in words.split():
                return code
    return s


def plain(line: str) -> str:
    """A line without mark-up, case and unseen characters."""
    s = _TAG.sub(" ", line)
    if not s.isascii():
        s = _UNSEEN.sub("", unicodedata.normalize("NFKC", s))
    return " ".join(s.lower().split())


def in_sentences(line: str) -> int:
    """Characters of a line if it holds sentences, 0 for a blank line, a heading or a list of names."""
    s = _TAG.sub(" ", line).strip()
    if len(_EAST.findall(s)) >= 8:
        return len(s)
    words = _WORD.findall(s)
    if len(words) < 5:
        return 0
    body = s.split(":", 1)[1] if re.match(r"^\W*[^\W\d_]+(?: [^\W\d_]+)?\s*:", s) else s
    parts = [len(_WORD.findall(p)) for p in re.split(r"[,;/|•·]", body)]
    parts = [p for p in parts if p]
    if len(parts) > 1 and sum(parts) / len(parts) <= 2.6 and max(parts) <= 4:
        return 0
    named = [w for w in _WORD.findall(body)]
    if named and all(w[0].isupper() for w in named) and not all(w.isupper() for w in named) and len(named) <= 12:
        return 0
    return len(s)


class Network:
    def __init__(self, n_labels: int = len(LANGS), seed: int = 7, weights: dict | None = None):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        h = HIDDEN
        self.w = weights or {
            "E": (0.3 * r.standard_normal((256, EMBED))).astype(np.float32),
            "X0": f(STEP * EMBED, 3 * h), "X1": f(STEP * EMBED, 3 * h), "U0": f(h, 3 * h), "U1": f(h, 3 * h),
            "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "O": f(2 * h, n_labels), "o": np.zeros(n_labels, np.float32),
        }

    @staticmethod
    def packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (steps, texts, STEP) of the texts, longest first; their steps; their order."""
        n = np.array([max(1, -(-len(t) // STEP)) for t in texts])
        order = np.argsort(-n, kind="stable")
        raw = np.frombuffer(b"".join(texts[i].ljust(n[order[0]] * STEP, b"\0") for i in order), np.uint8)
        return raw.reshape(len(texts), n[order[0]], STEP).transpose(1, 0, 2), n[order], order

    def _run(self, x: np.ndarray, n: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, texts, HIDDEN) of one direction. Texts that have ended, or not begun, take no part in a step."""
        h3, u, h = x, self.w[f"U{way}"], HIDDEN
        steps, b = x.shape[:2]
        state, out, kept = np.zeros((b, h), np.float32), np.zeros((steps, b, h), np.float32), [None] * steps
        live = np.searchsorted(-n, -np.arange(steps), "left")  # texts with more steps than t
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            m = live[t]
            s = state[:m]
            g = s @ u
            a = h3[t, :m]
            zr = 1 / (1 + np.exp(-(a[:, : 2 * h] + g[:, : 2 * h])))
            z, r, gn = zr[:, :h], zr[:, h:], g[:, 2 * h :]
            c = np.tanh(a[:, 2 * h :] + r * gn)
            if keep:
                kept[t] = (s.copy(), z, r, gn, c)
            state[:m] = c + z * (s - c)
            out[t, :m] = state[:m]
        return out, kept

    def forward(self, texts: list[bytes], keep: bool = False):
        raw, n, order = self.packed(texts)
        e = self.w["E"][raw].reshape(*raw.shape[:2], STEP * EMBED)
        runs = [self._run(e @ self.w[f"X{k}"] + self.w[f"b{k}"], n, k, keep) for k in (0, 1)]
        both = np.concatenate([runs[0][0], runs[1][0]], 2)
        logit = both @ self.w["O"] + self.w["o"]
        p = np.exp(logit - logit.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        mask = (np.arange(raw.shape[0])[:, None] < n).astype(np.float32)
        return p, mask, n, order, raw, e, runs, both

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean of its positions' probabilities, and their number."""
        out, size = np.zeros((len(texts), len(self.w["o"])), np.float32), np.zeros(len(texts))
        by_size = np.argsort([len(t) for t in texts], kind="stable")
        for k in range(0, len(texts), 1024):
            some = by_size[k : k + 1024]
            p, mask, n, order = self.forward([texts[i] for i in some])[:4]
            at = some[order]
            out[at] = (p * mask[:, :, None]).sum(0) / n[:, None]
            size[at] = n
        return out, size

    def gradient(self, texts: list[bytes], y: np.ndarray) -> tuple[float, dict]:
        """Mean loss of all positions' labels, and its gradient by backpropagation through time."""
        p, mask, n, order, raw, e, runs, both = self.forward(texts, keep=True)
        y = y[order]
        share = mask / n / len(texts)
        loss = -(np.log(np.take_along_axis(p, y[None, :, None], 2)[:, :, 0] + 1e-9) * share).sum()
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d *= share[:, :, None]
        g = {"O": np.tensordot(both, d, ((0, 1), (0, 1))), "o": d.sum((0, 1))}
        dh = d @ self.w["O"].T
        de, h = np.zeros_like(e), HIDDEN
        live = np.searchsorted(-n, -np.arange(len(p)), "left")
        for way in (0, 1):
            u, kept = self.w[f"U{way}"], runs[way][1]
            back, gu, gx = np.zeros((len(texts), h), np.float32), np.zeros_like(u), np.zeros((*e.shape[:2], 3 * h), np.float32)
            for t in range(len(p) - 1, -1, -1) if way == 0 else range(len(p)):
                m = live[t]
                s, z, r, gn, c = kept[t]
                a = dh[t, :m, way * h : (way + 1) * h] + back[:m]
                dc = a * (1 - z) * (1 - c * c)
                dz = a * (s - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                dg = np.concatenate([dz, dr, dc * r], 1)
                gx[t, :m] = np.concatenate([dz, dr, dc], 1)
                gu += s.T @ dg
                back[:m] = a * z + dg @ u.T
            g[f"U{way}"] = gu
            g[f"X{way}"] = np.tensordot(e, gx, ((0, 1), (0, 1)))
            g[f"b{way}"] = gx.sum((0, 1))
            de += gx @ self.w[f"X{way}"].T
        ge = np.zeros_like(self.w["E"])
        flat = raw.reshape(-1)
        for k in range(EMBED):
            ge[:, k] = np.bincount(flat, de.reshape(-1, EMBED)[:, k], 256)
        g["E"] = ge
        return float(loss), g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01, seed: int = 3) -> list[float]:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses, t, steps = [], 0, max(1, epochs * (len(texts) // size + 1))
        for _ in range(epochs):
            order = r.permutation(len(texts))
            # Near sizes together, batches in random order.
            order = np.concatenate([o[np.argsort([len(texts[i]) for i in o], kind="stable")] for o in np.array_split(order, max(1, len(order) // (size * 16)))])
            for k in r.permutation(range(0, len(order), size)):
                some = order[k : k + size]
                loss, g = self.gradient([texts[i] for i in some], y[some])
                t += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step = rate * (1 - t / (steps + 1))
                for name in self.w:
                    x = g[name] * min(1.0, 1.0 / (norm + 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.99 * v[name] + 0.01 * x * x
                    self.w[name] = (self.w[name] - step * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                losses.append(loss)
        return losses

    def dumped(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **self.w)
        return f.getvalue()

    @staticmethod
    def loaded(raw: bytes) -> Network:
        with np.load(io.BytesIO(raw)) as f:
            return Network(weights={k: f[k] for k in f.files})


def without_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("đ", "d").replace("ß", "ss")


def trained(texts: list[str], labels: list[str], seed: int = 7) -> Network:
    """The network fitted on the documents' lines, each with its document's label.

    Lines are as many for each language. Some are taken without accents, some cut short. After a first fit the lines whose label the
    network finds very unlikely (other languages in a mixed document, wrong labels) are left out, and it is fitted again.
    """
    r = np.random.default_rng(seed)
    by: dict[int, list[str]] = {k: [] for k in range(len(LANGS))}
    for t, lang in sorted(zip(texts, labels)):
        by[LANGS.index(lang)] += [plain(x) for x in t.split("\n") if in_sentences(x)]
    lines, y = [], []
    for k, all_lines in by.items():
        some = [all_lines[i] for i in r.permutation(len(all_lines))[:LINES]]
        for s in some:
            if r.random() < (0.4 if k == 1 else 0.15):
                s = without_accents(s)
            b = s.encode()[:400]
            if r.random() < 0.3:
                i = int(r.integers(0, max(1, len(b) - 40)))
                b = b[i : i + int(r.integers(30, 160))]
            lines.append(b)
            y.append(k)
    net, y = Network(seed=seed), np.array(y, np.int64)
    if not lines:
        return net
    net.fit(lines, y, epochs=2)
    p = net.pooled(lines)[0]
    good = np.flatnonzero(p[np.arange(len(y)), y] > 0.4)
    if len(good) and len(np.unique(y[good])) == len(np.unique(y)):
        net = Network(seed=seed)
        net.fit([lines[i] for i in good], y[good], epochs=6)
    return net


def _parts(s: str) -> list[bytes]:
    b = s.encode()
    return [b[k : k + LINE] for k in range(0, len(b), LINE)]


def labelled(net: Network, texts: list[str | None]) -> list[tuple[str | None, float, list[tuple[int, int, str, float]]]]:
    """For each text its language (None without sentences, 'mul' for several), a confidence, and its runs (first line, last, language, confidence)."""
    split = [t.split("\n") if t else [] for t in texts]
    need: dict[str, int] = {}
    flags = []
    for lines in split:
        f = [in_sentences(x) for x in lines]
        flags.append(f)
        for x, k in zip(lines, f):
            if k:
                need.setdefault(x, len(need))
    pieces, of = [], []
    for x, k in need.items():
        for b in _parts(plain(x)) or [b" "]:
            pieces.append(b)
            of.append(k)
    probs = np.zeros((len(need), len(LANGS)))
    if pieces:
        p, n = net.pooled(pieces)
        np.add.at(probs, np.array(of), p * n[:, None])
        probs /= probs.sum(1, keepdims=True)
    out = []
    for lines, f in zip(split, flags):
        runs, own = [], [need[x] for x, k in zip(lines, f) if k]
        # The pooled probabilities of the document's other lines stand beside each line's own.
        pool = (probs[own] * np.array([k for k in f if k])[:, None]).sum(0) / max(1, sum(f)) if own else np.zeros(len(LANGS))
        for i, (x, k) in enumerate(zip(lines, f), 1):
            if not k:
                if runs:
                    runs[-1][1] = i
                continue
            rest = sum(f) - k
            others = (pool * sum(f) - probs[need[x]] * k) / rest if rest > 0 else 0.0
            p = probs[need[x]] * (others + BESIDE)
            p /= p.sum()
            lang = LANGS[int(p.argmax())]
            if not runs or runs[-1][2] != lang:
                runs.append([i, i, lang, 0.0, 0])
            runs[-1][1] = i
            runs[-1][3] += float(p.max()) * k
            runs[-1][4] += k
        chars = sum(f)
        names = {r[2] for r in runs}
        lang = None if chars < LEAST_CHARS else next(iter(names)) if len(names) == 1 else "mul"
        out.append((lang, float(pool.max()) if runs else 0.0, [(a, b, x, s / k) for a, b, x, s, k in runs]))
    return out


def meanings(labels: DataFrame, label: str) -> DataFrame:
    """(label, declared) of the distinct labels."""
    def said(s: pd.Series) -> pd.Series:
        return s.map(declared, na_action=None)

    return labels.select(label).distinct().withColumn("declared", F.pandas_udf(said, "string")(F.col(label)))


def fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> bytes:
    """Weights of a network trained, in one task, on at most per_language documents of each declared language, those of the lowest hash.

    docs (key, text) and labels (key, label) are joined without the texts; those of the sample alone are then fetched.
    """
    kinds = meanings(labels, label).filter(F.col("declared").isin(LANGS))
    light = labels.select(key, label).join(kinds, label).join(docs.filter(F.length(text) >= LEAST_CHARS).select(key), key).select(key, "declared", F.xxhash64(F.col(key).cast("string")).alias("x"))
    # The lowest of each of 64 parts first, so that no task sorts a whole language.
    some = light.withColumn("r", F.row_number().over(Window.partitionBy("declared", F.pmod("x", F.lit(64))).orderBy("x", key))).filter(F.col("r") <= per_language)
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("declared").orderBy("x", key))).filter(F.col("r") <= per_language).select(key, "declared")

    def fit(sample: pa.Table) -> pa.Table:
        net = trained(sample.column("t").to_pylist(), sample.column("declared").to_pylist())
        return pa.table({"w": pa.array([net.dumped()], pa.binary())})

    sample = docs.select(key, F.col(text).alias("t")).join(F.broadcast(some), key).select("t", "declared")  # at most per_language x 5 ids
    rows = sample.groupBy(F.lit(1).alias("g")).applyInArrow(fit, "w binary").collect()
    return rows[0]["w"] if rows else Network().dumped()


def languages(docs: DataFrame, key: str, text: str, weights: bytes) -> DataFrame:
    """Rows (key, lang, confidence, runs): runs is an array of (line_from, line_to, lang, confidence).

    lang is null for a null, empty or short text and one without sentences, 'mul' for a text of several languages. Lines are split at
    line feeds and counted from 1; a line without sentences belongs to the run before it, if there is one. Repeated rows come out
    as often as they went in; a null key stays null; other columns are not read; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    run = pa.list_(pa.struct([("line_from", pa.int32()), ("line_to", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.loaded(weights)
        for whole in batches:
            for b in (whole.slice(k, 2000) for k in range(0, whole.num_rows, 2000)):
                got = labelled(net, b.column(1).to_pylist())
                runs = [[dict(zip(("line_from", "line_to", "lang", "confidence"), r)) for r in g[2]] for g in got]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(runs, run)], ["k", "lang", "confidence", "runs"])

    schema = f"k {kind}, lang string, confidence double, runs array<struct<line_from: int, line_to: int, lang: string, confidence: double>>"
    return spread(rows).mapInArrow(read, schema).withColumnRenamed("k", key)


def mislabelled(found: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """The rows of `found` whose label is missing or isn't the one language of the whole text; several languages never agree with a label."""
    said = labels.select(key, label).join(meanings(labels, label).filter("declared IS NOT NULL"), label).select(key, "declared")
    return found.filter("lang IS NOT NULL").join(said.distinct(), key, "left").filter("declared IS NULL OR declared <> lang")
