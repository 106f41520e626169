"""How alike the postings of a title are, against chance, and how alike titles are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.plans.staging import small

# Postings from which a title is looked at; random groups of the baseline; levels of likeness; share from which a skill is shared.
TITLE_LEAST, ROUNDS, LEVELS, SHARED = 5, 1000, (0.9, 0.8, 0.7), 0.5
BLOCK = 500


def dispersion(df: DataFrame, title: str, key: str, skills: str, least: int = TITLE_LEAST) -> DataFrame:
    """(title, n_postings, dispersion): 1 less the mean Jaccard likeness of all pairs of the title's postings, two without skills being unlike.

    Equal sets of skills of a title are one, with the number of its postings. Sets are packed in blocks; each pair of blocks is one row, multiplied in
    one task and dealt by title and both blocks, so that a title of any size spreads over all tasks and no pair of postings becomes a row. Titles
    of fewer than `least` postings and null titles are left out.
    """
    rows = df.filter(F.col(title).isNotNull() & F.col(skills).isNotNull()).select(F.col(title).alias("g"), F.array_sort(F.array_distinct(F.array_compact(skills))).alias("s"))
    sets = rows.groupBy("g", "s").agg(F.count("*").alias("c"))
    size = sets.groupBy("g").agg(F.sum("c").alias("n"), F.count("*").alias("sets")).filter(F.col("n") >= least)
    dealt = sets.join(size, "g").withColumn("b", F.pmod(F.xxhash64("s"), F.ceil(F.col("sets") / BLOCK)))
    blocks = dealt.groupBy("g", "b", "n").agg(F.collect_list("s").alias("x"), F.collect_list("c").alias("cx"))
    other = blocks.select("g", F.col("b").alias("b2"), F.col("x").alias("y"), F.col("cx").alias("cy"))
    both = blocks.join(other, "g").filter("b <= b2").select("g", "n", (F.col("b") == F.col("b2")).alias("same"), "x", "y", "cx", "cy", "b", "b2")
    both = both.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "b", "b2").drop("b", "b2")

    def likeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, n, same, x, y, cx, cy in pdf.itertuples(index=False):
                words = {w: i for i, w in enumerate(sorted({w for s in x for w in s} | {w for s in y for w in s}))}
                a, b = np.zeros((len(x), max(1, len(words))), np.float32), np.zeros((len(y), max(1, len(words))), np.float32)
                for m, rows_ in ((a, x), (b, y)):
                    for i, s in enumerate(rows_):
                        m[i, [words[w] for w in s]] = 1
                joint = a @ b.T
                whole = a.sum(1)[:, None] + b.sum(1)[None, :] - joint
                like = np.divide(joint, whole, out=np.zeros_like(joint), where=whole > 0).astype(np.float64)
                p, q = np.asarray(cx, np.float64), np.asarray(cy, np.float64)
                total = p @ like @ q
                if same:  # each pair once, none of a posting with itself
                    total = (total - p @ np.diag(like)) / 2
                out.append((g, n, total))
            yield pd.DataFrame(out, columns=["g", "n", "t"])

    got = both.mapInPandas(likeness, "g string, n long, t double").groupBy("g", "n").agg(F.sum("t").alias("t"))
    mean = F.col("t") / (F.col("n") * (F.col("n") - 1) / 2)
    return got.select(F.col("g").alias("title"), F.col("n").alias("n_postings"), F.round(1 - mean, 4).alias("dispersion"))


def skipped(df: DataFrame, title: str, skills: str, least: int = TITLE_LEAST) -> DataFrame:
    return df.filter(F.col(title).isNotNull() & F.col(skills).isNotNull()).groupBy(F.col(title).alias("title")).agg(F.count("*").alias("n_postings")).filter(F.col("n_postings") < least)


def baseline(df: DataFrame, key: str, skills: str, sizes: DataFrame, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """(n_postings, baseline_mean, baseline_p5, baseline_p95) of the dispersion of random groups of each size in `sizes`.

    Groups of that very size are drawn without replacement from all postings. A task holds each distinct set of skills once, as bits, with the
    number of its postings; the rounds of each size are spread over the tasks and their pairs are counted in blocks.
    """
    rows = df.filter(F.col(skills).isNotNull()).select(F.array_distinct(F.array_compact(skills)).alias("s"))
    words = {r[0]: i for i, r in enumerate(small(rows.select(F.explode("s").alias("w")).distinct().orderBy("w")))}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.zeros((len(pdf), max(1, len(words))), np.uint8)
            for i, s in enumerate(pdf.s):
                m[i, [words[w] for w in s]] = 1
            yield pd.DataFrame({"b": [x.tobytes() for x in np.packbits(m, axis=1)]})

    sets = rows.mapInPandas(pack, "b binary").groupBy("b").agg(F.count("*").alias("c")).toPandas()
    sets = sets.assign(b=sets.b.map(bytes)).sort_values("b")
    bits = np.frombuffer(b"".join(sets.b), np.uint8).reshape(len(sets), -1)
    upto = np.cumsum(sets.c.to_numpy(np.int64))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, i in pdf.itertuples(index=False):
                k = int(min(n, upto[-1]))
                drawn = np.random.default_rng([seed, int(n), int(i)]).choice(upto[-1], k, replace=False, shuffle=False)
                m = np.unpackbits(bits[np.searchsorted(upto, drawn, "right")], axis=1).astype(np.float32)
                out.append((n, 1 - _pair_sum(m) / (k * (k - 1) / 2)))
            yield pd.DataFrame(out, columns=["n_postings", "d"])

    grid = sizes.select("n_postings").distinct().crossJoin(sizes.sparkSession.range(rounds).withColumnRenamed("id", "i"))
    tasks = max(sizes.sparkSession.sparkContext.defaultParallelism * 4, 1)
    got = grid.repartition(tasks, F.xxhash64("n_postings", "i")).mapInPandas(draw, "n_postings long, d double").groupBy("n_postings")
    return got.agg(F.round(F.avg("d"), 4).alias("baseline_mean"), *[F.round(F.percentile("d", F.lit(p / 100)), 4).alias(f"baseline_p{p}") for p in (5, 95)])


def _pair_sum(m: np.ndarray) -> float:
    """The sum of the Jaccard likeness of all pairs of rows of a 0/1 matrix, two empty rows being unlike."""
    size, total = m.sum(1), 0.0
    for i in range(0, len(m), BLOCK):
        a = m[i : i + BLOCK]
        for j in range(i, len(m), BLOCK):
            joint = a @ m[j : j + BLOCK].T
            whole = size[i : i + BLOCK, None] + size[None, j : j + BLOCK]
            whole -= joint
            np.maximum(whole, 1, out=whole)
            joint /= whole
            total += joint.sum(dtype=np.float64) if j > i else (joint.sum(dtype=np.float64) - np.trace(joint, dtype=np.float64)) / 2
    return float(total)


def with_baseline(found: DataFrame, base: DataFrame) -> DataFrame:
    return found.join(base, "n_postings").select("title", "n_postings", "dispersion", "baseline_mean", "baseline_p5", "baseline_p95", (F.col("dispersion") < F.col("baseline_p5")).alias("informative"))


def profiles(df: DataFrame, title: str, skills: str, least: int = TITLE_LEAST) -> DataFrame:
    """(title, skill, share, n_postings): the share of the title's postings that hold the skill."""
    rows = df.filter(F.col(title).isNotNull() & F.col(skills).isNotNull()).select(F.col(title).alias("title"), F.array_distinct(F.array_compact(skills)).alias("s"))
    n = rows.groupBy("title").agg(F.count("*").alias("n_postings")).filter(F.col("n_postings") >= least)
    each = rows.select("title", F.explode("s").alias("skill")).groupBy("title", "skill").agg(F.count("*").alias("c"))
    return each.join(n, "title").select("title", "skill", (F.col("c") / F.col("n_postings")).alias("share"), "n_postings")


def likeness(profile: DataFrame) -> DataFrame:
    """(title_a, title_b, cosine) of the titles' profiles that have a skill in common."""
    norm = profile.groupBy("title").agg(F.sqrt(F.sum(F.col("share") * F.col("share"))).alias("norm"))
    a = profile.select("skill", F.col("title").alias("title_a"), F.col("share").alias("x"))
    b = profile.select("skill", F.col("title").alias("title_b"), F.col("share").alias("y"))
    dot = a.join(b, "skill").filter("title_a < title_b").groupBy("title_a", "title_b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    of = lambda t: norm.select(F.col("title").alias(t), F.col("norm").alias(f"norm_{t}"))
    return dot.join(of("title_a"), "title_a").join(of("title_b"), "title_b").select("title_a", "title_b", F.round(F.col("dot") / (F.col("norm_title_a") * F.col("norm_title_b")), 4).alias("cosine"))


def flagged(like: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The pairs at or over the lowest level, each with the highest level that it reaches."""
    level = None
    for x in sorted(levels, reverse=True):
        level = F.when(F.col("cosine") >= x, x) if level is None else level.when(F.col("cosine") >= x, x)
    return like.withColumn("level", level).filter("level IS NOT NULL")


def notable(profile: DataFrame, like: DataFrame, n: int = 5, share: float = SHARED) -> DataFrame:
    """The n most alike pairs with the skills that at least `share` of the postings hold: of both, and of one only."""
    often = profile.filter(F.col("share") >= share).groupBy("title").agg(F.array_sort(F.collect_set("skill")).alias("s"))
    top = like.orderBy(F.desc("cosine"), "title_a", "title_b").limit(n)
    of = lambda t, c: often.select(F.col("title").alias(t), F.col("s").alias(c))
    x, y = (F.coalesce(c, F.array().cast("array<string>")) for c in ("x", "y"))
    both = top.join(of("title_a", "x"), "title_a", "left").join(of("title_b", "y"), "title_b", "left")
    text = lambda a: F.array_join(F.array_sort(a), ", ")
    return both.select("title_a", "title_b", "cosine", text(F.array_intersect(x, y)).alias("shared"), text(F.array_except(x, y)).alias("only_a"), text(F.array_except(y, x)).alias("only_b"))


def top_skills(profile: DataFrame, n: int = 10) -> DataFrame:
    """(title, n_postings, rank, skill, share) of each title's n most frequent skills."""
    w = Window.partitionBy("title").orderBy(F.desc("share"), "skill")
    return profile.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("title", "n_postings", "rank", "skill", F.round("share", 4).alias("share"))


def profile_matrix(profile: DataFrame, skills: list[str]) -> DataFrame:
    return profile.groupBy("title").pivot("skill", skills).agg(F.round(F.first("share"), 4)).fillna(0.0)
