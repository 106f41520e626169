"""Consensus of several annotators' labels by a community confusion model.

Every annotator belongs to one of a few types; a type has a confusion matrix shared by its annotators, and each annotator's own
matrix is drawn towards that of the type, the more so the fewer labels there are. Variational updates alternate between
the items' probabilities and the matrices. Items with the same votes by the same annotators are one weighted pattern, so
that an update works on the distinct patterns; it sums per annotator with partial aggregation, and only the types' few
numbers pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import cut
from jobweave.llm.stable_sample import plain_id
from jobweave.plans.staging import dropped

#: Where the types start: the chance to give a label that is due, and one that isn't.
TYPES = ((0.95, 0.02), (0.8, 0.1), (0.95, 0.5), (0.5, 0.1), (0.5, 0.4))
#: Updates end when no expected number of labels changes by more than this share of all; MOST updates without that are an error.
SETTLED, MOST = 1e-4, 500
PULL = 10.0  # labels' worth of a type's matrix in each annotator's own


def digamma(x: np.ndarray) -> np.ndarray:
    up = x + 6
    return np.log(up) - 1 / (2 * up) - 1 / (12 * up**2) + 1 / (120 * up**4) - sum(1 / (x + k) for k in range(6))


def plain_name(c: Column) -> Column:
    """One spelling of an annotator's name; null for a missing or blank one."""
    return F.regexp_replace(plain_id(c), r"[\s\p{Z}_\-.]+", "_")


class Consensus:
    """The fitted model: `items` (posting, label, p, votes, given), `annotators`, `agreement`."""

    def __init__(self, df: DataFrame, item: str, annotator: str, labels: Column, settled: float = SETTLED, types: tuple = TYPES, pull: float = PULL, unnamed: bool = False):
        """df: a row per submission, `labels` the array of labels given in it.

        A submission without item or annotator is left out; a null array gives no label but withholds all; null labels and repeats
        count not at all; an annotator who submits twice gives what stands in either. Labels are those that anybody gives;
        each that an item was given by anybody is a question to all of its annotators; with `unnamed`, so is every other label, which
        suits false labels given at random rather than for something in the item. An empty table gives empty results.
        Updates go on until they are settled; `rounds` tells how many that took.
        """
        one = df.select(plain_id(df[item]).alias("j"), plain_name(df[annotator]).alias("a"), F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("s")).dropna()
        one = one.groupBy("j", "a").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"))
        posts = one.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("a", "s"))).alias("v")).withColumn("all", F.array_distinct(F.flatten("v.s")))
        posts = cut(posts)
        line = lambda l: F.array_join(F.transform("v", lambda x: F.concat(x["a"], F.when(F.array_contains(x["s"], l), "+").otherwise("-"))), " ")  # noqa: E731, E741
        items = posts.select("j", "v", F.explode("all").alias("l")).select("j", "l", line(F.col("l")).alias("p"))
        patterns = items.select("p", F.lit(1).alias("w"))
        if unnamed:  # withheld by all annotators of the item; they count by their number
            n_labels = posts.select(F.explode("all").alias("l")).distinct().count()
            patterns = patterns.unionByName(posts.select(F.array_join(F.transform("v", lambda x: F.concat(x["a"], F.lit("-"))), " ").alias("p"), (F.lit(n_labels) - F.size("all")).alias("w")))
        patterns = patterns.groupBy("p").agg(F.sum("w").cast("double").alias("w")).filter("w > 0")
        cell = F.explode(F.split("p", " ")).alias("c")
        votes = patterns.select("p", "w", cell).select("p", "w", F.expr("substring(c, 1, length(c) - 1)").alias("a"), (F.substring("c", -1, 1) == "+").cast("double").alias("y"))
        self.votes, self.posts, self.raw_items = cut(votes), posts, items
        prior, params = 0.0, None
        # Types' matrices as numbers of labels: [type, 0: due or 1: not due, 0: given or 1: withheld].
        start = 50 * np.array([[[g, 1 - g], [b, 1 - b]] for g, b in types])
        strength, mix = start, np.log(np.full(len(types), 1 / len(types)))
        before, self.rounds, written = None, 0, []
        while True:
            if self.rounds == MOST:
                raise RuntimeError(f"not settled after {MOST} updates")
            self.rounds += 1
            written.append(stats := cut(self._stats(prior, params)))
            part = stats.mapInPandas(_summed(strength, mix), ", ".join(f"s{i} double" for i in range(5 * len(types) + 2)))
            sums = np.array([x or 0.0 for x in part.agg(*[F.sum(c).alias(c) for c in part.columns]).first()])
            prior = float(np.log(sums[-2] + 1) - np.log(sums[-1] + 1))
            held = sums[: len(types)] + 1
            strength, mix = start + sums[len(types) : -2].reshape(-1, 2, 2), digamma(held) - digamma(held.sum(keepdims=True))
            params = stats.filter("a <> ''").mapInPandas(_own(strength, mix, pull), "a string, type int, gives_due double, withholds_undue double, g1 double, h1 double, g0 double, h0 double")
            if len(written) > 1:  # the one before is not read any more
                dropped(written.pop(0))
            labels_ = sums[len(types) : -2].sum()
            if before is not None and np.abs(sums - before).max() <= settled * max(1.0, labels_):
                break
            before = sums
        self.prior, self.params = prior, params

    def _scored(self, prior: float, params: DataFrame | None) -> DataFrame:
        """The votes with q, the probability that the label is due, from all votes of the pattern."""
        if params is None:
            return self.votes.join(self.votes.groupBy("p").agg(F.avg("y").alias("q")), "p")
        v = self.votes.join(params, "a").withColumn("x", F.when(F.col("y") > 0, F.col("g1") - F.col("g0")).otherwise(F.col("h1") - F.col("h0")))
        odds = v.groupBy("p").agg((F.lit(prior) + F.sum("x")).alias("o"))
        return self.votes.join(odds.select("p", (1 / (1 + F.exp(-F.col("o")))).alias("q")), "p")

    def _stats(self, prior: float, params: DataFrame | None) -> DataFrame:
        """Per annotator the expected numbers of labels due and given (d1) or withheld (d0), not due and given (n1) or withheld (n0); in row '' the items due (d1) and not (d0)."""
        v = self._scored(prior, params)
        w, q, y = F.col("w"), F.col("q"), F.col("y")
        own = v.groupBy("a").agg(F.sum(w * q * y).alias("d1"), F.sum(w * q * (1 - y)).alias("d0"), F.sum(w * (1 - q) * y).alias("n1"), F.sum(w * (1 - q) * (1 - y)).alias("n0"))
        items = v.groupBy("p").agg(F.first("w").alias("w"), F.first("q").alias("q"))
        total = items.agg(F.sum(w * q).alias("d1"), F.sum(w * (1 - q)).alias("d0")).select(F.lit("").alias("a"), "d1", "d0", F.lit(0.0).alias("n1"), F.lit(0.0).alias("n0"))
        return own.unionByName(total)

    def items(self) -> DataFrame:
        """(item, label, probability) of every label anybody gave."""
        q = self._scored(self.prior, self.params).groupBy("p").agg(F.first("q").alias("q"))
        return self.raw_items.join(q, "p").select(F.col("j").alias("item"), F.col("l").alias("label"), F.col("q").alias("probability"))

    def annotators(self) -> DataFrame:
        """(annotator, n_items, gives_due, withholds_undue, reliability, type): reliability is gives_due + withholds_undue - 1."""
        n = self.posts.select(F.explode("v.a").alias("a")).groupBy("a").agg(F.count("*").alias("n_items"))
        return self.params.join(n, "a").select(F.col("a").alias("annotator"), "n_items", "gives_due", "withholds_undue", (F.col("gives_due") + F.col("withholds_undue") - 1).alias("reliability"), "type")

    def agreement(self) -> DataFrame:
        """(item, n_annotators, n_labels, agreement): over the labels anybody gave the item, the mean share of pairs of annotators that treat it alike; null for one annotator or no label."""
        n = F.size("v")
        alike = F.transform("all", lambda l: F.aggregate("v", F.lit(0), lambda s, x: s + F.array_contains(x["s"], l).cast("int")))  # noqa: E741
        share = F.aggregate(F.transform(alike, lambda k: (k * (k - 1) + (n - k) * (n - k - 1)) / (n * (n - 1))), F.lit(0.0), lambda s, x: s + x) / F.size("all")
        return self.posts.select(F.col("j").alias("item"), n.alias("n_annotators"), F.size("all").alias("n_labels"), F.when((n > 1) & (F.size("all") > 0), share).alias("agreement"))


def _people(pdf: pd.DataFrame) -> np.ndarray:
    """[annotator, due or not, given or withheld]"""
    return pdf[["d1", "d0", "n1", "n0"]].to_numpy(float).reshape(-1, 2, 2)


def _membership(n: np.ndarray, strength: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """[annotator, type]: the probability of each type."""
    e = digamma(strength) - digamma(strength.sum(2, keepdims=True))
    logs = mix + np.einsum("azy,mzy->am", n, e)
    r = np.exp(logs - logs.max(1, keepdims=True))
    return r / r.sum(1, keepdims=True)


def _summed(strength: np.ndarray, mix: np.ndarray):
    """Per batch of annotators: the types' members, their labels by type, and the items due and not."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, people = pdf[pdf.a == ""], pdf[pdf.a != ""]
            n = _people(people)
            r = _membership(n, strength, mix)
            row = np.concatenate([r.sum(0), np.einsum("am,azy->mzy", r, n).ravel(), [total.d1.fillna(0).sum(), total.d0.fillna(0).sum()]])
            yield pd.DataFrame([row], columns=[f"s{i}" for i in range(len(row))])

    return f


def _own(strength: np.ndarray, mix: np.ndarray, pull: float):
    """Each annotator's matrix, from their own labels and `pull` labels' worth of their type's, and its expected logarithms."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean = strength / strength.sum(2, keepdims=True)
        for pdf in batches:
            n = _people(pdf)
            r = _membership(n, strength, mix)
            a = n + pull * np.einsum("am,mzy->azy", r, mean)
            e = digamma(a) - digamma(a.sum(2, keepdims=True))
            p = a / a.sum(2, keepdims=True)
            yield pd.DataFrame({"a": pdf.a, "type": r.argmax(1).astype("int32"), "gives_due": p[:, 0, 0], "withholds_undue": p[:, 1, 1], "g1": e[:, 0, 0], "h1": e[:, 0, 1], "g0": e[:, 1, 0], "h0": e[:, 1, 1]})

    return f
