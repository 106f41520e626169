"""Blind clustering of postings by their skills, or of any vectors: k-means with stability, choice of k, quality, agreement."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from jobweave.plans.staging import settle, small

# Rows from which clustering makes sense; slack in choosing k; the numbers of clusters, starts and stability rounds of a whole sweep.
LEAST_ROWS, SLACK = 300, 0.02
KS, STARTS, ROUNDS = tuple(range(2, 16)), 10, 100
STABILITY_ROWS = 400_000  # distinct vectors of up to 128 values that a task holds in a sweep (some 200 MB); with more, each fit is spread over all executors
BLOCK = 512  # rows of a product of matrices
LINKED = 12_000  # distinct sets of skills of which a task holds all distances for average linkage (4 bytes each)
AT_ONCE = 4  # fits that run side by side


def vectors(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), array_to_vector(F.col(column).cast("array<double>")).alias("features"))


def skill_vectors(df: DataFrame, key: str, skills: str, vocabulary: list[str]) -> DataFrame:
    return df.select(F.col(key).alias("id"), array_to_vector(F.array(*[F.coalesce(F.array_contains(skills, s), F.lit(False)).cast("double") for s in vocabulary])).alias("features"))


def fit(data: DataFrame, k: int, starts: int = STARTS, seed: int = 42) -> KMeansModel:
    """The best of several starts by its cost."""
    data = data.persist()
    try:
        with ThreadPool(AT_ONCE) as pool:
            models = pool.map(inheritable_thread_target(lambda i: KMeans(k=k, seed=seed + i, maxIter=50).fit(data)), range(starts), 1)
    finally:
        data.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(labelled: DataFrame) -> float:
    return ClusteringEvaluator(distanceMeasure="cosine", predictionCol="prediction").evaluate(labelled)


def davies_bouldin(labelled: DataFrame, label: str = "prediction", features: str = "features") -> float | None:
    """Mean over clusters of the worst ratio of spreads to centre distance; null for one cluster. Two aggregations; k x k on the driver."""
    rows = labelled.select(F.col(label).alias("c"), vector_to_array(features).alias("v")) if dict(labelled.dtypes)[features] == "vector" else labelled.select(F.col(label).alias("c"), F.col(features).cast("array<double>").alias("v"))
    flat = rows.select("c", F.posexplode("v").alias("i", "x"))
    centre = {r["c"]: np.array([y["m"] for y in sorted(r["m"], key=lambda y: y["i"])]) for r in flat.groupBy("c", "i").agg(F.avg("x").alias("m")).groupBy("c").agg(F.collect_list(F.struct("i", "m")).alias("m")).collect()}
    if len(centre) < 2:
        return None
    table = rows.sparkSession.createDataFrame([(c, m.tolist()) for c, m in centre.items()], "c int, m array<double>")
    far = F.sqrt(F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    spread = {r["c"]: r["s"] for r in rows.join(F.broadcast(table), "c").groupBy("c").agg(F.avg(far).alias("s")).collect()}
    return float(np.mean([max((spread[a] + spread[b]) / max(float(np.linalg.norm(centre[a] - centre[b])), 1e-12) for b in centre if b != a) for a in centre]))


class _Vectors:
    """Distinct vectors with the number of rows that have each: dense with a column of ones, and their values other than zero one row after the other."""

    def __init__(self, packed: list[bytes], rows: np.ndarray, dims: int):
        self.rows, self.dims = rows.astype(np.float64), dims
        size = np.array([len(p) // 8 for p in packed], np.int64)
        both = [np.frombuffer(p, np.uint32).reshape(2, -1) for p in packed]
        self.at = np.concatenate([x[0] for x in both]).astype(np.int64) if both else np.zeros(0, np.int64)
        self.value = np.concatenate([x[1].view(np.float32) for x in both]) if both else np.zeros(0, np.float32)
        self.size, self.first = size, np.cumsum(size) - size

    def dense(self) -> np.ndarray:
        x = np.zeros((len(self.size), self.dims + 1), np.float32)
        x[np.repeat(np.arange(len(x)), self.size), self.at] = self.value
        x[:, -1] = 1
        return x

    def sums(self, of: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, before: np.ndarray | None = None) -> np.ndarray:
        """Sums by label of the vectors of these numbers, times their weights, less those by the labels before: whole numbers, and so exact, for vectors of 0 and 1."""
        n = self.size[of]
        place = np.repeat(self.first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at, value = self.at[place], np.repeat(weight, n) * self.value[place]
        got = np.bincount(np.repeat(label * self.dims, n) + at, value, k * self.dims)
        if before is not None:
            got = got - np.bincount(np.repeat(before * self.dims, n) + at, value, k * self.dims)
        return got.reshape(k, -1)


def _packed(data: DataFrame) -> DataFrame:
    """(v, n): the distinct vectors, as the places of their values other than zero and these, and the number of rows with each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf.v.tolist(), np.float32)
                row, at = np.nonzero(x)
                cut, value = np.searchsorted(row, np.arange(len(x) + 1)).tolist(), x[row, at].view(np.uint32)
                yield pd.DataFrame({"v": [np.concatenate([at[i:j].astype(np.uint32), value[i:j]]).tobytes() for i, j in zip(cut[:-1], cut[1:])]})

    return data.select(vector_to_array("features").cast("array<float>").alias("v")).mapInPandas(pack, "v binary").groupBy("v").agg(F.count("*").alias("n"))


def _held(data: DataFrame) -> _Vectors | None:
    """The rows as distinct vectors, or nothing where these are more than a task holds."""
    row = data.select(F.size(vector_to_array("features")).alias("d")).first()
    dims = row["d"] if row else 0
    most = STABILITY_ROWS * 128 // max(dims, 128)
    got = _packed(data).limit(most + 1).toPandas()
    if len(got) > most:
        return None
    got = got.sort_values("v")  # whatever the order of the rows
    return _Vectors(got.v.tolist(), got.n.to_numpy(np.int64), dims)


def _lloyd(v: _Vectors, x: np.ndarray, weight: np.ndarray, k: int, r: np.random.Generator, starts: int = STARTS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centres) for each row of weights of the vectors: of the best of several starts by the sum of squared distances.

    x: the vectors, dense. All starts that still move go through the same products of matrices, a block of vectors at a time; the centres are
    means of sums to which only the vectors that changed are added. Labels of vectors of weight 0 mean nothing.
    """
    n, dims, every = len(x), v.dims, len(weight) * starts
    of = np.arange(every) // starts  # the row of weights of each start
    own, light, drawn = np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]), weight.astype(np.float32), weight > 0
    pick = lambda upto: min(int(np.searchsorted(upto, r.random() * upto[-1], "right")), n - 1)
    centre, near, upto = np.empty((every, k, dims), np.float32), None, np.cumsum(weight, 1)
    for j in range(k):  # each next centre by the squared distance from those before it
        at = [pick(upto[of[s]] if near is None else np.cumsum(near[s] * weight[of[s]])) for s in range(every)]
        centre[:, j] = c = x[at, :-1]
        d = np.concatenate([-2 * c, (c * c).sum(1)[:, None]], 1) @ x.T
        d += own
        near = np.maximum(d, 0, out=d) if near is None else np.minimum(near, np.maximum(d, 0, out=d), out=near)
    small = np.min_scalar_type(k)
    codes = np.arange(k, 0, -1).astype(small)[:, None]  # the first of equal centres has the highest
    label, live, sums = np.full((every, n), k, small), np.arange(every), np.zeros((every, k, dims + 1))
    for step in range(rounds):
        c = centre[live].reshape(-1, dims)
        c, now = np.concatenate([-c, (c * c).sum(1)[:, None] / 2], 1), np.empty((len(live), n), small)
        for i in range(0, n, BLOCK):
            b = x[i : i + BLOCK]
            d = (c @ b.T).reshape(len(live), k, -1)
            now[:, i : i + BLOCK] = k - ((d == d.min(1)[:, None]).view(np.uint8) * codes).max(1)
            if not step:
                one = (now[:, None, i : i + BLOCK] == np.arange(k, dtype=small)[:, None]) * light[of, None, i : i + BLOCK]
                sums += (one.reshape(every * k, -1) @ b).reshape(sums.shape)
        moved = np.zeros(len(live), bool)
        for i, s in enumerate(live):
            if step:
                some = np.flatnonzero((now[i] != label[s]) & drawn[of[s]])
                new, old, w = now[i, some].astype(np.int64), label[s, some].astype(np.int64), weight[of[s], some]
                sums[s, :, :-1] += v.sums(some, new, w, k, old)
                sums[s, :, -1] += np.bincount(new, w, k) - np.bincount(old, w, k)
            label[s], moved[i] = now[i], not step or len(some)
            if step < rounds - 1:
                centre[s] = np.where(sums[s, :, -1:] > 0, sums[s, :, :-1] / np.maximum(sums[s, :, -1:], 1), centre[s])
        live = live[moved]
        if not len(live):
            break
    # Squared distances from the means, but for what all starts have in common.
    cost = -((sums[..., :-1] ** 2).sum(2) / np.maximum(sums[..., -1], 1)).sum(1).reshape(-1, starts)
    best = cost.argmin(1) + np.arange(len(weight)) * starts
    return label[best].astype(np.int64), centre[best].astype(np.float64)


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    return _rand_of(table)


def _rand_of(table: np.ndarray) -> float:
    pairs = lambda x: float((x * (x - 1) / 2).sum())
    s, p, q, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum(keepdims=True))
    top, base = (p + q) / 2, p * q / n
    return 1.0 if top == base else (s - base) / (top - base)


def stability(data: DataFrame, ks: list[int], rounds: int = ROUNDS, share: float = 0.8, starts: int = STARTS, seed: int = 42) -> DataFrame:
    """(k, stability): the mean agreement of two clusterings of random parts of all rows, on the rows that both have.

    Up to STABILITY_ROWS distinct vectors the (k, round) grid is spread over the tasks, each of which holds them; with more, the fits of a round are spread.
    """
    held = _held(data)
    if held is None:
        return _stability_spread(data, ks, rounds, share, starts, seed)
    return _grid(data, held, [(k, i) for k in ks for i in range(rounds)], share, starts, seed).groupBy("k").agg(F.round(F.avg("ari"), 4).alias("stability"))


def _grid(data: DataFrame, held: _Vectors, grid: list[tuple[int, int]], share: float, starts: int, seed: int) -> DataFrame:
    """(k, ari, silhouette, davies_bouldin, centres): the agreement of each round i of k; for i = -1 the figures of a fit to all rows."""
    sc = data.sparkSession.sparkContext
    every = sc.broadcast(held)
    tasks = max(1, min(len(grid), 16 * sc.defaultParallelism))
    order = sorted(grid, key=lambda g: (g[1] >= 0, -g[0], g[1]))  # the longest first, dealt over the tasks
    dealt = data.sparkSession.createDataFrame(sc.parallelize([g for t in range(tasks) for g in order[t::tasks]], tasks), "k int, i int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, out = every.value, []
        x, owner = v.dense(), np.repeat(np.arange(len(v.rows)), v.rows.astype(np.int64))
        for k, i in (g for pdf in batches for g in pdf.itertuples(index=False)):
            r = np.random.default_rng([seed, k, i + 1])
            if i < 0:
                label, centre = _lloyd(v, x, v.rows[None], k, r, starts, 50)
                out.append((k, None, *_figures(v, x, label[0], k), centre[0].ravel().tolist()))
                continue
            part = np.zeros((2, len(owner)), bool)
            for p in part:
                p[r.choice(len(p), int(share * len(p)), replace=False)] = True
            both = np.bincount(owner[part[0] & part[1]], minlength=len(x))
            if both.sum() < max(k, 2):
                continue
            label, _ = _lloyd(v, x, np.array([np.bincount(owner[p], minlength=len(x)) for p in part], np.float64), k, r, starts)
            out.append((k, _rand_of(np.bincount(label[0] * k + label[1], both, k * k).reshape(k, k)), None, None, None))
        yield pd.DataFrame(out, columns=["k", "ari", "silhouette", "davies_bouldin", "centres"])

    return dealt.mapInPandas(run, "k int, ari double, silhouette double, davies_bouldin double, centres array<double>")


def _figures(v: _Vectors, x: np.ndarray, label: np.ndarray, k: int) -> tuple[float | None, float | None]:
    """(silhouette by cosine, Davies-Bouldin) of all rows. A vector of zeros is at distance 1 from all others; a row alone in its cluster counts 0."""
    every, size = np.arange(len(x)), np.bincount(label, v.rows, k)
    own = np.einsum("ij,ij->i", x[:, :-1], x[:, :-1]).astype(np.float64)
    some = size > 0
    if some.sum() < 2:
        return None, None
    mean = v.sums(every, label, v.rows, k) / np.maximum(size, 1)[:, None]
    turn = v.sums(every, label, v.rows / np.sqrt(np.where(own > 0, own, 1)), k)
    value, far = np.zeros(len(x)), np.zeros(len(x))
    for i in range(0, len(x), BLOCK):
        b = x[i : i + BLOCK, :-1].astype(np.float64)
        l, at = label[i : i + BLOCK], np.arange(len(b))
        far[i : i + BLOCK] = np.sqrt(((b - mean[l]) ** 2).sum(1))
        unit = b / np.sqrt(np.where(own[i : i + BLOCK] > 0, own[i : i + BLOCK], 1))[:, None]
        whole = size - unit @ turn.T  # summed distances to each cluster's rows
        inner = (whole[at, l] - (own[i : i + BLOCK] == 0)) / np.maximum(size[l] - 1, 1)
        outer = np.where(some, whole / np.maximum(size, 1), np.inf)
        outer[at, l] = np.inf
        outer = outer.min(1)
        most = np.maximum(inner, outer)
        value[i : i + BLOCK] = np.where((size[l] > 1) & (most > 1e-12), (outer - inner) / np.where(most > 1e-12, most, 1), 0)
    mean, spread = mean[some], (np.bincount(label, far * v.rows, k) / np.maximum(size, 1))[some]
    apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
    worst = (spread[:, None] + spread[None]) / np.maximum(apart, 1e-12)
    np.fill_diagonal(worst, -np.inf)
    return float((value * v.rows).sum() / v.rows.sum()), float(worst.max(1).mean())


def _model(data: DataFrame, centres: np.ndarray) -> KMeansModel:
    """Spark's model of these centres."""
    jvm, gateway = data.sparkSession._jvm, data.sparkSession.sparkContext._gateway
    points = gateway.new_array(jvm.org.apache.spark.mllib.linalg.Vector, len(centres))
    for i, c in enumerate(centres.tolist()):
        point = gateway.new_array(jvm.double, len(c))
        for j, y in enumerate(c):
            point[j] = y
        points[i] = jvm.org.apache.spark.mllib.linalg.DenseVector(point)
    return KMeansModel(jvm.org.apache.spark.ml.clustering.KMeansModel(f"KMeans_{uuid.uuid4().hex[:12]}", jvm.org.apache.spark.mllib.clustering.KMeansModel(points)))


def _stability_spread(data: DataFrame, ks: list[int], rounds: int, share: float, starts: int, seed: int) -> DataFrame:
    """`stability` with distributed fits: the parts are drawn by hashes of id, k and round."""
    data, out = settle(data), []
    for k in ks:
        got = []
        for i in range(rounds):
            drawn = [F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(f"{seed}:{k}:{i}:{part}")), F.lit(1 << 32)) < int(share * (1 << 32)) for part in "ab"]
            a, b = (fit(data.filter(c), k, starts, seed + starts * (2 * i + n)) for n, c in enumerate(drawn))
            both = b.setPredictionCol("b").transform(a.setPredictionCol("a").transform(data.filter(drawn[0] & drawn[1]))).groupBy("a", "b").count().collect()
            table = np.zeros((k, k))
            for r in both:
                table[r["a"], r["b"]] = r["count"]
            if table.sum() >= max(k, 2):
                got.append(_rand_of(table))
        if got:
            out.append((k, round(float(np.mean(got)), 4)))
    return data.sparkSession.createDataFrame(out, "k int, stability double")


def sweep(data: DataFrame, ks: list[int], starts: int = STARTS, rounds: int = ROUNDS, seed: int = 42) -> tuple[pd.DataFrame, dict[int, KMeansModel]]:
    """A table (k, silhouette, davies_bouldin, stability) and the models."""
    held = _held(data)
    if held is None:
        return _sweep_spread(data, ks, starts, rounds, seed)
    got = _grid(data, held, [(k, i) for k in ks for i in range(-1, rounds)], 0.8, starts, seed).toPandas()
    steady = got[got.ari.notna()].groupby("k").ari.mean().round(4)
    whole = {r.k: r for r in got[got.centres.notna()].itertuples()}
    out = [(k, round(whole[k].silhouette, 4), whole[k].davies_bouldin, steady.get(k)) for k in ks]
    return pd.DataFrame(out, columns=["k", "silhouette", "davies_bouldin", "stability"]), {k: _model(data, np.array(whole[k].centres).reshape(k, -1)) for k in ks}


def _sweep_spread(data: DataFrame, ks: list[int], starts: int, rounds: int, seed: int) -> tuple[pd.DataFrame, dict[int, KMeansModel]]:
    """`sweep` with distributed fits."""
    steady = {r["k"]: r["stability"] for r in _stability_spread(data, ks, rounds, 0.8, starts, seed).collect()}
    out, models = [], {}
    for k in ks:
        models[k] = fit(data, k, starts, seed)
        labelled = models[k].transform(data).persist()
        out.append((k, round(silhouette(labelled), 4), davies_bouldin(labelled), steady.get(k)))
        labelled.unpersist()
    return pd.DataFrame(out, columns=["k", "silhouette", "davies_bouldin", "stability"]), models


def choose_k(table: pd.DataFrame, slack: float = SLACK) -> int:
    """Of the k whose stability is near the best, those whose silhouette is; of these the smallest."""
    t = table[table.stability >= table.stability.max() - slack]
    t = t[t.silhouette >= t.silhouette.max() - slack]
    return int(t.k.min())


def profiles(df: DataFrame, label: str, skills: str, n: int = 5) -> DataFrame:
    """(cluster, n_jobs, top_skills): each cluster's size and its n most frequent skills."""
    size = df.groupBy(F.col(label).alias("cluster")).agg(F.count("*").alias("n_jobs"))
    each = df.select(F.col(label).alias("cluster"), F.explode(F.array_distinct(F.array_compact(skills))).alias("s")).groupBy("cluster", "s").agg(F.count("*").alias("c"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "s"))).filter(F.col("r") <= n)
    return size.join(top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]), ", ").alias("top_skills")), "cluster", "left")


def top_titles(df: DataFrame, label: str, title: str, n: int = 3) -> DataFrame:
    """(cluster, titles): each cluster's n most frequent titles, joined only once the labels are fixed."""
    each = df.filter(F.col(title).isNotNull()).groupBy(F.col(label).alias("cluster"), F.col(title).alias("t")).agg(F.count("*").alias("c"))
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "t"))).filter(F.col("r") <= n)
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), ", ").alias("titles"))


def exemplars(labelled: DataFrame, n: int = 3) -> DataFrame:
    """(cluster, rank, id, cosine): each cluster's n rows nearest to its centre by cosine, of equal ones the first id."""
    v = labelled.select("id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    centre = v.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("m", "m"))
    near = v.join(F.broadcast(centre), "cluster").withColumn("cosine", F.when(norm > 0, F.round(dot("v", "m") / norm, 4)).otherwise(0.0))
    w = Window.partitionBy("cluster").orderBy(F.desc("cosine"), "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("cluster", "rank", "id", "cosine")


def upgma(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 to k - 1 of average-linkage clustering of a square distance matrix, numbered by first member."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), [[i] for i in range(n)]
    alive = np.ones(n, bool)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        member[i] += member[j]
        alive[j] = False
    out = np.zeros(n, int)
    for c, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(member[i]))):
        out[member[i]] = c
    return out


def average_linkage(d: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 to k - 1 as `upgma` gives, of points that stand for `size` rows each, by chains of nearest neighbours; d is overwritten."""
    n, size, merges, chain, at = len(d), [float(x) for x in size], [], [], list(range(len(d)))
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    while len(merges) < n - 1:
        chain = chain or [int(alive.argmax())]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        merges.append((float(d[i, j]), i, j))
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for _, i, j in sorted(merges, key=lambda m: m[0])[: n - k]:
        a, b = root(i), root(j)
        at[max(a, b)] = min(a, b)
    return np.unique([root(x) for x in range(n)], return_inverse=True)[1]


def hierarchical(df: DataFrame, key: str, skills: str, k: int, most: int = LINKED) -> DataFrame:
    """(key, cluster) of average linkage on Jaccard distance, over distinct sets of skills that count as often as they occur.

    Quadratic by nature, so refused over `most` distinct sets.
    """
    rows = df.select(F.col(key).cast("string"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(skills), F.array().cast("array<string>"))))).alias("s"))
    sets = settle(rows.groupBy("s").agg(F.count("*").alias("n")))
    if sets.count() > most:
        raise ValueError(f"more than {most} distinct sets")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([pd.DataFrame({"s": [], "n": []}), *batches])
        x = sorted(zip(map(list, pdf.s), pdf.n))
        words = {w: i for i, w in enumerate(sorted({w for s, _ in x for w in s}))}
        m = np.zeros((len(x), max(1, len(words))), np.float32)
        for i, (s, _) in enumerate(x):
            m[i, [words[w] for w in s]] = 1
        size, d = m.sum(1), np.empty((len(x), len(x)), np.float32)
        for i in range(0, len(x), 500):
            joint = m[i : i + 500] @ m.T
            d[i : i + 500] = 1 - joint / np.maximum(size[i : i + 500, None] + size[None] - joint, 1)
        yield pd.DataFrame({"s": [s for s, _ in x], "cluster": average_linkage(d, np.array([n for _, n in x]), min(k, len(x))) if x else []})

    return rows.join(settle(sets.repartition(1).mapInPandas(link, "s array<string>, cluster int")), "s").select(key, "cluster")


def coordinates(data: DataFrame) -> DataFrame:
    """(id, x, y): the first two principal components of the centred vectors."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(data).transform(data)
    got = PCA(k=2, inputCol="centred", outputCol="xy").fit(centred).transform(centred)
    return got.select("id", vector_to_array("xy").alias("xy")).select("id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def compare_methods(df: DataFrame, key: str, skills: str, k: int, title: str, vocabulary: list[str]) -> DataFrame:
    """(method, n, k, silhouette, davies_bouldin, largest_share, singletons, ari, nmi, ari_between, nmi_between): k-means and average linkage, held against titles and each other.

    n: the postings looked at. These are all, but average linkage takes the LINKED of lowest hash where there are more distinct sets of skills than that.
    """
    from jobweave.operators.agreement import hash_sample, partition_agreement

    data = settle(skill_vectors(df, key, skills, vocabulary).withColumn("id", F.col("id").cast("string")))
    some = df.withColumn(key, F.col(key).cast("string"))
    if some.select(F.array_sort(F.array_distinct(F.array_compact(skills)))).distinct().count() > LINKED:
        some = settle(hash_sample(some.select(key, skills), key, LINKED, "methods:"))
    linked = settle(hierarchical(some, key, skills, k).select(F.col(key).alias("id"), F.col("cluster").alias("prediction")))
    means = settle(fit(data, k).transform(data))
    between = partition_agreement(means.select("id", "prediction").join(linked.withColumnRenamed("prediction", "linked"), "id"), "prediction", "linked").first()
    rows = []
    for name, labelled in (("kmeans", means), ("average_linkage", settle(data.join(linked, "id")))):
        sizes = [r[0] for r in labelled.groupBy("prediction").count().select("count").collect()]
        with_title = labelled.select(F.col("id").cast("string").alias("id"), "prediction").join(df.select(F.col(key).cast("string").alias("id"), title), "id")
        like = partition_agreement(with_title, "prediction", title).first()
        several = len(sizes) > 1
        rows.append((name, sum(sizes), len(sizes), round(silhouette(labelled), 4) if several else None, davies_bouldin(labelled) if several else None, round(max(sizes) / sum(sizes), 4), sum(s == 1 for s in sizes), like["ari"], like["nmi"], between["ari"], between["nmi"]))
    return df.sparkSession.createDataFrame(rows, "method string, n long, k int, silhouette double, davies_bouldin double, largest_share double, singletons int, ari double, nmi double, ari_between double, nmi_between double")


def title_order(likeness: DataFrame) -> DataFrame:
    """(title, position): titles in the order in which average linkage over 1 - cosine joins them; for charts, so of few titles."""
    pairs = small(likeness.select("title_a", "title_b", "cosine").orderBy("title_a", "title_b"), 500_000)
    names = sorted({t for r in pairs for t in r[:2]})
    at = {t: i for i, t in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for a, b, c in pairs:
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - c
    groups = [upgma(d, k) for k in range(1, len(names) + 1)] if names else []
    order = sorted(range(len(names)), key=lambda i: [g[i] for g in groups])
    return likeness.sparkSession.createDataFrame([(names[i], p) for p, i in enumerate(order)], "title string, position int")
