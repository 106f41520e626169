"""New batches checked for repeats against everything accepted before.

The accepted rows of all batches so far are kept as immutable segments in a shared folder: a suffix array over their
concatenated texts, and the fingerprints of their pages, source ids and texts in order. A new batch's own suffixes and fingerprints
are binary-searched in the segments, and in suffix arrays of the batch itself; matches are extended and what they cover is summed for each
pair of records. So of the history only the pages that the searches touch are read, and the texts of records that share enough with a new one.

Which rows of the batch are accepted follows from the links, in order of arrival, in rounds over the rows that have any. Then
the batch becomes a segment, and segments of one level are merged into one of the next, so that there are few.
A manifest names the segments; it is replaced as a whole once new files are complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import cut, spread
from jobweave.llm.folding import plain
from jobweave.llm.suffixes import OFFSET, Array, Library, Texts, exactly, looked_up, mounted, new_name, sampled, search
from jobweave.plans.staging import dropped, file_system, new_path

LEAST_CHARS = 60  # shorter texts say nothing
COVERED = 0.68  # share of both texts, by bytes, that matches must cover
LIKELY = 0.4  # the same for the matches around sampled suffixes, from which all are looked at
TEXT_BYTES = 128 << 20  # of one text file
RANGE = 4_000_000  # suffixes in one file of a merged array
KEYS = ("u", "i", "c")
KINDS = {"suffixes": "S32", "keys": "i8"}
ROWS = "o long, u long, i long, c long, part long, file string, at long, size int"
# Fixed value: query fields of an address that don't tell pages apart.
INCIDENTAL = r"^(utm_\w+|trk|clk|ref|refid|src|fbclid|gclid|msclkid|mc_[ce]id|session\w*|sid|click_?id|tracking\w*|share\w*)$"


def page(url: Column) -> Column:
    """What tells the page of an address: host, path and query without incidental parts; null for a blank or missing one.

    Set aside: blanks, http or https, upper case and www. in the host, the usual ports, escapes of plain characters, a
    closing slash, the fragment, tracking fields and the order of the others.
    """
    u = F.regexp_replace(F.regexp_replace(url, r"[\s\p{Z}\p{Cf}]+", ""), "#.*$", "")
    for code, c in (("2D", "-"), ("5F", "_"), ("2E", "."), ("7E", "~")):
        u = F.regexp_replace(u, f"(?i)%{code}", c)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "[&;]"), lambda x: (x != "") & ~F.lower(F.split(x, "=")[0]).rlike(INCIDENTAL))
    kind = F.when(scheme.isin("http", "https", ""), "").otherwise(F.concat(scheme, F.lit(":")))
    return F.when(rest != "", F.concat(kind, host, path, F.lit("?"), F.array_join(F.array_sort(fields), "&")))


@dataclass
class Manifest:
    """What the store holds. texts: text files by number; segments: per segment its level, and the files of its suffixes and keys with the least entry of each."""

    version: int = 0
    last: int = -1
    texts: dict[int, str] = field(default_factory=dict)
    segments: list[dict] = field(default_factory=list)
    decided: list[str] = field(default_factory=list)

    @staticmethod
    def read(text: str) -> Manifest:
        m = Manifest(**json.loads(text))
        m.texts = {int(k): v for k, v in m.texts.items()}
        return m


@dataclass
class Batch:
    """A batch made ready: its rows (ROWS and `first`, the first row with the text), and the numbers of its text files."""

    rows: DataFrame
    texts: dict[int, str]


class Store:
    """The accepted rows of all batches so far, in a folder that all executors share.

    Columns read of a batch: batch, id, url, source, source_id, text (by the names given); others are not, whatever their names.
    Rows arrive by (batch, id), a missing batch first; a row without id is left out; ids are unique and lie in 0 to 2**43, batches in 0 to 2**19. Missing or
    blank addresses and ids and texts of fewer than LEAST_CHARS characters link nothing. Empty tables give empty results.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._fs, self._at = file_system(spark, path)
        self.path = self._fs.makeQualified(self._at(path.rstrip("/"))).toString()
        self._fs.mkdirs(self._at(self.path))
        self._next = 0

    # ---- the manifest

    def _versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> Manifest:
        """The newest manifest; one is complete once it has its name."""
        found = self._versions()
        if not found:
            return Manifest()
        stream = self._fs.open(self._at(f"{self.path}/manifest-{found[-1]}.json"))
        try:
            return Manifest.read(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> None:
        m.version += 1
        temporary = self._at(f"{new_name(self.path, 'temporary')}")
        stream = self._fs.create(temporary)
        stream.write(bytearray(json.dumps(asdict(m)).encode()))
        stream.close()
        if not self._fs.rename(temporary, self._at(f"{self.path}/manifest-{m.version}.json")):
            raise OSError(f"manifest {m.version} of {self.path} is there already: another writer?")

    def sweep(self, texts: bool = False) -> None:
        """Removes what the manifest doesn't name: files of writes that failed, and of segments that were merged.

        Not while a batch is being checked; with `texts` also text files, when no batch made ready is still to be checked.
        """
        m = self.manifest()
        named = {f"manifest-{m.version}.json", *(p.rsplit("/", 1)[1] for p in [*m.texts.values(), *m.decided])}
        named |= {f["path"].rsplit("/", 1)[1] for s in m.segments for f in s["suffixes"] + s["keys"]}
        for x in self._fs.listStatus(self._at(self.path)):
            name = x.getPath().getName()
            if name not in named and name.rsplit(".", 1)[0] not in named and (texts or not name.startswith("texts-")):
                self._fs.delete(x.getPath(), True)

    def segments(self) -> dict[int, list[dict]]:
        """Segments by level."""
        out: dict[int, list[dict]] = {}
        for s in self.manifest().segments:
            out.setdefault(s["level"], []).append(s)
        return dict(sorted(out.items()))

    def accepted(self) -> DataFrame | None:
        """(o) of all accepted rows."""
        paths = self.manifest().decided
        return self.spark.read.schema("o long, a long").parquet(*paths).filter("a IS NULL").select("o") if paths else None

    # ---- a batch

    def prepare(self, rows: DataFrame, by_batch: bool = False, **columns: str) -> Batch | dict[int, Batch]:
        """The rows folded and fingerprinted, their texts in text files of the store. With by_batch for each of several batches, by number."""
        base = self._next = max(self._next, max(self.manifest().texts, default=-1) + 1)
        folded = cut(_narrow(rows, **columns).mapInArrow(_folded(self.path, base), ROWS).withColumn("batch", F.shiftright("o", 43)))
        texts = folded.filter("c IS NOT NULL")
        firsts = texts.groupBy("batch", "c").agg(F.min("o").alias("first"))
        path = new_path(self.spark)
        done = texts.join(firsts.hint("shuffle_hash"), ["batch", "c"]).unionByName(folded.filter("c IS NULL").withColumn("first", F.lit(None).cast("long")))
        done.write.partitionBy("batch").parquet(path)
        files: dict[int, dict[int, str]] = {}
        for batch, part, file in folded.select("batch", "part", "file").distinct().collect():  # a few for each task
            files.setdefault(batch, {}).update({} if file is None else {part: file})
        self._next = max([base, *(n + 1 for x in files.values() for n in x)])
        dropped(folded)
        read = lambda at: self.spark.read.schema(f"{ROWS}, first long").parquet(at)
        if by_batch:
            return {b: Batch(read(f"{path}/batch={b}"), files[b]) for b in sorted(files)}
        return Batch(read(path), {k: v for x in files.values() for k, v in x.items()})

    def check(self, batch: DataFrame | Batch, **columns: str) -> Checked:
        """The batch's links to accepted rows and within itself, and which of its rows are accepted. An earlier batch than the last is refused."""
        b = batch if isinstance(batch, Batch) else self.prepare(batch, **columns)
        return Checked(self, b)

    def add(self, checked: Checked) -> None:
        """The accepted rows of a checked batch as a new segment, merged with those of its level; the manifest changes at the end, at once."""
        m = self.manifest()
        if m.version != checked.version:
            raise ValueError("the batch was checked against an older state of the store")
        if checked.last is None:
            return
        level, inputs = 0, []
        while same := [s for s in m.segments if s["level"] == level]:
            inputs += same
            m.segments = [s for s in m.segments if s["level"] != level]
            level += 1
        m.segments.append({"level": level} | self._merge(inputs, checked, m.texts))
        m.texts |= checked.batch.texts
        m.decided.append(checked.path)
        m.last = checked.last
        self._publish(m)
        self.sweep()

    def _merge(self, inputs: list[dict], checked: Checked, texts: dict[int, str]) -> dict:
        """The files of the merged segment; each task writes one range of the suffixes or of the keys."""
        ranges, old, new = [], {}, {}
        for what, kind in KINDS.items():
            old[what], new[what] = [f["path"] for s in inputs for f in s[what]], [f["path"] for f in checked.runs[what]]
            n = sum(f["n"] for s in inputs for f in s[what]) + sum(f["n"] for f in checked.runs[what])
            bounds = _bounds(old[what] + new[what], kind, -(-n // RANGE))
            ranges += [(what, low, high) for low, high in zip([None, *bounds], [*bounds, None])]
        tasks = self.spark.range(len(ranges), numPartitions=len(ranges))
        made = tasks.mapInArrow(_merging(ranges, old, new, texts | checked.batch.texts, checked.path, self.path), "what string, path string, least string, n long").collect()
        return {what: sorted(({k: r[k] for k in ("path", "least", "n")} for r in made if r["what"] == what), key=lambda r: _key(r["least"], kind)) for what, kind in KINDS.items()}


def _key(least: str, kind: str):
    return bytes.fromhex(least) if kind == "S32" else int(least)


def _bounds(paths: list[str], kind: str, n: int) -> list:
    """n - 1 entries that part the arrays evenly, from evenly spaced entries of each: a few thousand, whatever their size."""
    if n < 2:
        return []
    some = []
    for p in paths:
        h = Array.open(p, kind).heads
        some.append(np.asarray(h[:: max(1, len(h) // (64 * n))]))
    every = np.sort(np.concatenate(some))
    return np.unique(every[np.linspace(0, len(every), n + 1).astype(int)[1:-1]]).tolist()


def _merging(ranges: list, old: dict, new: dict, texts: dict[int, str], decided: str, folder: str):
    """Merges one range of the arrays; of the batch's own ones only what belongs to accepted rows stays."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, ids = Library(texts), _accepted(decided)

        def stays(what: str, places: np.ndarray) -> np.ndarray:
            if what == "keys":
                return np.isin(places, ids)
            out = np.zeros(len(places), bool)
            number = places >> OFFSET
            for no in np.unique(number).tolist():
                t, here = library[no], np.flatnonzero(number == no)
                rec = np.searchsorted(t.starts, places[here] & ((1 << OFFSET) - 1), "right") - 1
                out[here] = np.isin(t.ids, ids)[rec]
            return out

        for b in batches:
            for i in b.column(0).to_pylist():
                what, *bounds = ranges[i]
                kind = KINDS[what]
                low, high = (np.array(x, kind) if x is not None else None for x in bounds)
                parts = [Array.open(p, kind).between(low, high) for p in old[what]]
                for p in new[what]:
                    h, q = Array.open(p, kind).between(low, high)
                    m = stays(what, q)
                    parts.append((h[m], q[m]))
                done = Array.of(*(np.concatenate(x) for x in zip(*parts)))
                if not len(done):
                    continue
                path = new_name(folder, what)
                done.write(path)
                least = bytes(done.heads[0]).hex() if what == "suffixes" else str(done.heads[0])
                yield pa.RecordBatch.from_pylist([{"what": what, "path": path, "least": least, "n": len(done)}])

    return f


def _accepted(path: str) -> np.ndarray:
    """The accepted rows of the batch, 8 bytes each."""
    import pyarrow.dataset as ds

    return np.sort(ds.dataset(mounted(path) or path, format="parquet").to_table(columns=["o"], filter=ds.field("a").is_null()).column("o").to_numpy())


class Checked:
    """A batch's links, and which of its rows are accepted."""

    def __init__(self, store: Store, batch: Batch):
        self.store, self.batch = store, batch
        m = store.manifest()
        self.version = m.version
        rows = batch.rows
        self.runs, ends = self._own_arrays(rows)
        self.last = max((x for _, x in ends), default=None)
        if self.last is not None and min(x for x, _ in ends) <= m.last:
            raise ValueError("the batch holds rows that come before accepted ones")
        self._link(rows, m)

    def _own_arrays(self, rows: DataFrame) -> tuple[dict, list]:
        """Each task's suffixes and keys in order, in files of the store."""
        schema = "what string, path string, n long, low long, high long"
        made = rows.mapInArrow(_run(self.store.path, self.batch.texts), schema).collect()  # two rows for each task
        runs = {w: [{"path": r["path"], "n": r["n"]} for r in made if r["what"] == w] for w in ("suffixes", "keys")}
        return runs, [(r["low"], r["high"]) for r in made if r["what"] == "keys"]

    def _link(self, rows: DataFrame, m: Manifest) -> None:
        find = _find(m.segments, [f["path"] for f in self.runs["suffixes"]], m.texts | self.batch.texts, m.last)
        found = rows.mapInArrow(find, "k long, whole boolean, g long, a long")
        # What holds for a text holds for every row with it.
        of = rows.select(F.col("o").alias("k"), F.lit(False).alias("whole"), "o").unionByName(rows.filter("first IS NOT NULL").select(F.col("first").alias("k"), F.lit(True).alias("whole"), "o"))
        # The rows of one page, source id or text are a group, of which each repeats the others; so are those with either of two like texts.
        keys = rows.select("o", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.xxhash64(F.lit(k), k)) for k in KEYS])).alias("g")).filter("g IS NOT NULL")
        crowd = keys.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
        # Joins by shuffling: a broadcast would pass through the driver, for each of many small joins.
        links = of.join(found.hint("merge"), ["k", "whole"]).select("o", "g", "a").unionByName(keys.join(crowd.hint("shuffle_hash"), "g").select("o", "g", F.lit(None).cast("long").alias("a")))
        self.links = cut(links)
        groups = self.links.filter("g IS NOT NULL").select("o", "g")

        def step(state: DataFrame) -> DataFrame:
            """Open rows that come first in all of their groups are accepted, those after an accepted one refused."""
            s = groups.join(state.hint("shuffle_hash"), "o")
            lead = s.groupBy("g").agg(F.min(F.when(F.col("s") == 1, F.col("o"))).alias("yes"), F.min(F.when(F.col("s").isNull(), F.col("o"))).alias("open")).filter("open IS NOT NULL")
            met = s.filter("s IS NULL").join(lead.hint("shuffle_hash"), "g").groupBy("o").agg(F.max(F.coalesce(F.col("yes") < F.col("o"), F.lit(False))).alias("no"), F.min(F.col("open") == F.col("o")).alias("leads"))
            fresh = met.select("o", F.when(F.col("no"), 0).when(F.col("leads"), 1).alias("s2"))
            return state.join(fresh.hint("shuffle_hash"), "o", "left").select("o", F.coalesce("s", "s2").alias("s"))

        # s: null open, 1 accepted, 0 refused.
        state = self.links.groupBy("o").agg(F.when(F.max(F.col("a").isNotNull()), 0).alias("s"))
        self.state = cut(step(step(state)))
        while not self.state.filter("s IS NULL").isEmpty():
            before, self.state = self.state, cut(step(step(self.state)))
            dropped(before)
        s = groups.join(self.state.hint("shuffle_hash"), "o")
        inside = s.filter("s = 0").select("g", "o").join(s.filter("s = 1").select("g", F.col("o").alias("a")).hint("shuffle_hash"), "g").filter("a < o").select("o", "a")
        repeated = self.links.filter("a IS NOT NULL").select("o", "a").unionByName(inside).distinct()
        accepted = rows.select("o").join(self.state.filter("s = 0").hint("shuffle_hash"), "o", "left_anti").select("o", F.lit(None).cast("long").alias("a"))
        self.path = new_name(self.store.path, "decided")
        accepted.unionByName(repeated).write.parquet(self.path)
        self.decided = self.store.spark.read.schema("o long, a long").parquet(self.path)

    def drop(self) -> None:
        """Removes the written tables that nothing needs once the batch is added."""
        dropped(self.links, self.state, self.batch.rows)

    def pairs(self) -> DataFrame:
        """(a, b): row b, not accepted, repeats the accepted row a, by any link; ids as given."""
        mask = F.lit((1 << 43) - 1)
        return self.decided.filter("a IS NOT NULL").select(F.col("a").bitwiseAND(mask).alias("a"), F.col("o").bitwiseAND(mask).alias("b"))


def repeats(rows: DataFrame, store: Store | None = None, **columns: str) -> DataFrame:
    """(a, b) of all the batches in rows, taken one after the other, each against the store of what was accepted before."""
    spark = rows.sparkSession
    store = store or Store(spark, new_path(spark))
    out = spark.createDataFrame([], "a long, b long")
    for batch in store.prepare(rows, by_batch=True, **columns).values():
        checked = store.check(batch)
        store.add(checked)
        checked.drop()
        out = out.unionByName(checked.pairs())
    return out


def _narrow(rows: DataFrame, batch: str = "batch_no", key: str = "raw_id", url: str = "source_url", source: str = "source", source_id: str = "source_job_id", text: str = "job_description") -> DataFrame:
    """(o, u, i, v): order, page, source id and text."""
    blank = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""), r"\s+", " "))
    o = F.shiftleft(F.coalesce(rows[batch].cast("long"), F.lit(0)), 43).bitwiseOR(rows[key].cast("long"))
    return spread(rows.filter(rows[key].isNotNull()).select(o.alias("o"), page(rows[url]).alias("u"), F.when((blank(rows[source_id]) != "") & (blank(rows[source]) != ""), F.concat_ws("\x1f", blank(rows[source]), blank(rows[source_id]))).alias("i"), F.when(F.length(rows[text]) >= LEAST_CHARS, rows[text]).alias("v")))


def _folded(folder: str, base: int):
    """(o, u, i, v) to ROWS; the folded texts go to text files, whose number, name and place stand in the rows."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        short = lambda s: None if s is None else xxhash.xxh3_64_intdigest(s) - (1 << 63)
        number = base + (TaskContext.get().partitionId() << 6)  # 64 files for a task: 8 GB of text
        ids, texts, used, path = [], [], 0, new_name(folder, "texts")
        for b in batches:
            c, part, file, at, size = [], [], [], [], []
            for o, v in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                t = plain(v) if v is not None else b""
                if used > TEXT_BYTES:
                    Texts.of(ids, texts).write(path)
                    number, path, ids, texts, used = number + 1, new_name(folder, "texts"), [], [], 0
                c.append(short(t) if t else None)
                part.append(number if t else None)
                file.append(path if t else None)
                at.append(used if t else None)
                size.append(len(t) if t else None)
                if t:
                    ids.append(o)
                    texts.append(t)
                    used += len(t) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([short(x) for x in b.column(i).to_pylist()], pa.int64()) for i in (1, 2)], pa.array(c, pa.int64()), pa.array(part, pa.int64()), pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int32())],
                ["o", "u", "i", "c", "part", "file", "at", "size"],
            )
        if ids:
            Texts.of(ids, texts).write(path)

    return f


def _asked(b: pa.RecordBatch, library: Library, picked: np.ndarray) -> tuple[Texts, np.ndarray]:
    """The picked rows' texts, and where these lie in the text files."""
    part, at, size = (b.column(n).take(pa.array(picked)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("part", "at", "size"))
    o = b.column("o").to_numpy()[picked]
    places = (part << OFFSET) | at
    return Texts.of(o, library.read(places, size)), places


def _firsts(b: pa.RecordBatch) -> np.ndarray:
    """The rows that are the first of their batch with their text."""
    import pyarrow.compute as pc

    return np.flatnonzero(pc.fill_null(pc.equal(b.column("o"), b.column("first")), False).to_numpy(zero_copy_only=False))


def _keys(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the pages, source ids and texts."""
    keys, row = [], []
    for n, k in enumerate(KEYS):
        c = b.column(k)
        has = np.flatnonzero(np.asarray(c.is_valid()))
        v = c.take(pa.array(has)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        keys.append(((v ^ np.uint64(n + 1)) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
        row.append(has)
    return np.concatenate(keys), np.concatenate(row)


def _run(folder: str, texts: dict[int, str]):
    """(what, path, n, low, high): a task's suffixes and keys, each in order in one file, and its least and last row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, key, owner, head, place, low, high = Library(texts), [], [], [], [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            o = b.column("o").to_numpy()
            low.append(o.min())
            high.append(o.max())
            k, row = _keys(b)
            key.append(k)
            owner.append(o[row])
            picked = _firsts(b)
            for n in range(0, len(picked), 2000):
                t, at_file = _asked(b, library, picked[n : n + 2000])
                at, doc, h = sampled(t)
                head.append(h)
                place.append(at_file[doc] + at - t.starts[doc])
        if not low:
            return
        none = (np.zeros(0, "S32"), np.zeros(0, np.int64))
        out = []
        for what, a in (("suffixes", Array.of(np.concatenate([none[0], *head]), np.concatenate([none[1], *place]))), ("keys", Array.of(np.concatenate(key), np.concatenate(owner)))):
            path = new_name(folder, what)
            a.write(path)
            out.append({"what": what, "path": path, "n": len(a), "low": int(min(low)), "high": int(max(high))})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("what", pa.string()), ("path", pa.string()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    return f


def _find(segments: list[dict], own: list[str], texts: dict[int, str], last: int):
    """Rows (k, whole, g, a): row k, or with `whole` every row with its text, repeats the accepted row a, or belongs to the group g of rows of the batch that repeat each other."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(texts)
        keys = [Array.open(x["path"], "i8") for s in segments for x in s["keys"]]
        arrays = [Array.open(p) for p in [*(x["path"] for s in segments for x in s["suffixes"]), *own]]
        schema = pa.schema([("k", pa.int64()), ("whole", pa.bool_()), ("g", pa.int64()), ("a", pa.int64())])
        for whole in batches:
            for b in (whole.slice(k, 1000) for k in range(0, whole.num_rows, 1000)):
                o = b.column("o").to_numpy()
                k, row = _keys(b)
                of_text = np.arange(len(k)) >= len(k) - (b.num_rows - b.column("c").null_count)
                kinds, of = np.unique(k, return_inverse=True)
                same_text = np.zeros(len(o), bool)
                out = []
                for a in keys:
                    x = looked_up(a, kinds)
                    hit = np.flatnonzero(x.n[of])
                    same_text[row[hit[of_text[hit]]]] = True
                    for j in hit.tolist():
                        at = int(x.low[of[j]])
                        out += [(int(o[row[j]]), False, None, int(p)) for p in x.places[at : at + int(x.n[of[j]])]]
                # A text that an accepted row has is like no other accepted one, or that row would not be accepted.
                picked = _firsts(b)
                t, _ = _asked(b, library, picked[~same_text[picked]])
                where = {x: i for i, x in enumerate(t.ids.tolist())}
                got = search(t, arrays, library, LIKELY)
                for x, y, p in zip(got.asked, got.other, got.places):
                    i = where[x]
                    if exactly(t.raw[t.starts[i] : t.starts[i + 1] - 1].tobytes(), library.text_at(p)) >= COVERED:
                        if y <= last:
                            out.append((x, True, None, y))
                        else:
                            g = hash((y, x)) & ((1 << 63) - 1)
                            out += [(x, True, g, None), (y, True, g, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 4, schema.types)], schema=schema)

    return f
