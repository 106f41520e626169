"""How well labels agree: precision and recall, kappa, ARI and NMI, and the merging of several people's labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _safe(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(per: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp and fn; 0 where nothing is divided by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per.withColumns({"precision": F.round(_safe(tp, tp + fp), 4), "recall": F.round(_safe(tp, tp + fn), 4), "f1": F.round(_safe(2 * tp, 2 * tp + fp + fn), 4)})


def compare_labels(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(id, label, outcome) of two long tables (id, label): tp, fp or fn."""
    g, p = gold.select("id", "label").distinct().withColumn("g", F.lit(1)), predicted.select("id", "label").distinct().withColumn("p", F.lit(1))
    return g.join(p, ["id", "label"], "full").select("id", "label", F.when(F.col("g").isNull(), "fp").when(F.col("p").isNull(), "fn").otherwise("tp").alias("outcome"))


def micro(outcomes: DataFrame) -> DataFrame:
    return scores(outcomes.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn")]))


def per_label(outcomes: DataFrame) -> DataFrame:
    return scores(outcomes.groupBy("label").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn")]))


def errors(outcomes: DataFrame) -> DataFrame:
    """(id, false_positives, false_negatives) of the items with any, sorted labels joined by '|'."""
    some = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.col("label")))), "|")
    return outcomes.filter("outcome <> 'tp'").groupBy("id").agg(some("fp").alias("false_positives"), some("fn").alias("false_negatives"))


def evaluation(gold: DataFrame, predicted: DataFrame, ids: DataFrame, salt: str = "gold-split-v1:") -> dict[str, DataFrame]:
    """Everything about predicted labels against gold ones, long tables (id, label), of the items in ids (id).

    metrics: a row for all items, one for each part of `split_by_hash`, with n_items, n_errors and the scores; per_label; errors; predictions (id, labels).
    Labels of other items are an error: both sides must be about the same items.
    """
    ids = ids.select("id").distinct()
    for name, side in (("gold", gold), ("predicted", predicted)):
        if not side.select("id").distinct().join(ids, "id", "left_anti").isEmpty():
            raise ValueError(f"{name} has labels of other items")
    outcomes = compare_labels(gold, predicted)
    wrong = errors(outcomes)
    parts = ids.select("id", F.explode(F.array(F.lit("all"), split_by_hash(F.col("id"), salt))).alias("subset"))
    n = parts.join(wrong.select("id", F.lit(1).alias("e")), "id", "left").groupBy("subset").agg(F.count("*").alias("n_items"), F.count("e").alias("n_errors"))
    counts = parts.join(outcomes, "id").groupBy("subset").agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("tp", "fp", "fn")])
    metrics = scores(n.join(counts, "subset", "left").fillna(0, ["tp", "fp", "fn"]))
    listed = ids.join(predicted.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels")), "id", "left").fillna("", "labels")
    return {"metrics": metrics, "per_label": per_label(outcomes), "errors": wrong, "predictions": listed}


def merge_choices(long: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """(item, label, status, n_people, people, choices) of people's single choices (item, person, label).

    status: adjudicated where a table (item, label) decides, else agreed, single (one person) or conflict, which has no label. A person who chose twice counts with
    the last label by code point. choices lists what each said, for conflicts.
    """
    one = long.filter("label IS NOT NULL AND person IS NOT NULL").groupBy("item", "person").agg(F.max("label").alias("label"))
    per = one.groupBy("item").agg(F.count("*").alias("n_people"), F.count_distinct("label").alias("n_labels"), F.min("label").alias("only"), F.array_sort(F.collect_list(F.struct("person", "label"))).alias("said"))
    decided = adjudicated.select("item", F.col("label").alias("decided")) if adjudicated is not None else per.select("item", F.lit(None).cast("string").alias("decided")).limit(0)
    per = per.join(decided, "item", "left")
    status = F.when(F.col("decided").isNotNull(), "adjudicated").when(F.col("n_labels") > 1, "conflict").when(F.col("n_people") == 1, "single").otherwise("agreed")
    choices = F.when(status == "conflict", F.array_join(F.transform("said", lambda x: F.concat(x["person"], F.lit(": "), x["label"])), " | "))
    return per.select("item", F.coalesce("decided", F.when(F.col("n_labels") == 1, F.col("only"))).alias("label"), status.alias("status"), "n_people", F.array_join(F.transform("said", lambda x: x["person"]), ";").alias("people"), choices.alias("choices"))


def choice_kappa(long: DataFrame) -> DataFrame:
    """(a, b, shared, agreement, kappa) of all pairs of people, over the items that both chose a label for."""
    one = long.filter("label IS NOT NULL AND person IS NOT NULL").groupBy("item", "person").agg(F.max("label").alias("label"))
    x, y = (one.select("item", F.col("person").alias(p), F.col("label").alias(f"l{p}")) for p in ("a", "b"))
    both = x.join(y, "item").filter("a < b")
    base = both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("po"))
    left = both.groupBy("a", "b", F.col("la").alias("l")).agg(F.count("*").alias("p"))
    right = both.groupBy("a", "b", F.col("lb").alias("l")).agg(F.count("*").alias("q"))
    chance = left.join(right, ["a", "b", "l"]).groupBy("a", "b").agg(F.sum(F.col("p").cast("double") * F.col("q")).alias("s"))
    pe = F.coalesce("s", F.lit(0.0)) / (F.col("shared").cast("double") * F.col("shared"))
    return base.join(chance, ["a", "b"], "left").select("a", "b", "shared", F.round("po", 4).alias("agreement"), F.round(F.when(pe >= 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 4).alias("kappa"))


def confused(long: DataFrame, n: int = 10) -> DataFrame:
    """(label_a, label_b, n): pairs of different labels that two people chose for one item, the n most frequent."""
    one = long.filter("label IS NOT NULL AND person IS NOT NULL").groupBy("item", "person").agg(F.max("label").alias("label"))
    x, y = (one.select("item", F.col("person").alias(f"p{p}"), F.col("label").alias(p)) for p in ("a", "b"))
    both = x.join(y, "item").filter("pa < pb AND a <> b").groupBy(F.least("a", "b").alias("label_a"), F.greatest("a", "b").alias("label_b")).agg(F.count("*").alias("n"))
    return both.orderBy(F.desc("n"), "label_a", "label_b").limit(n)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, observed, expected, kappa) of two people's labels of the same items; 1 where chance alone agrees wholly."""
    both = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"))
    left, right = both.groupBy(F.col(a).alias("l")).agg(F.count("*").alias("x")), both.groupBy(F.col(b).alias("l")).agg(F.count("*").alias("y"))
    pe = left.join(right, "l").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("s"))
    e = F.col("s") / (F.col("n").cast("double") * F.col("n"))
    return n.crossJoin(F.broadcast(pe)).select("n", F.round("po", 6).alias("observed"), F.round(e, 6).alias("expected"), F.round(F.when(e >= 1, 1.0).otherwise((F.col("po") - e) / (1 - e)), 6).alias("kappa"))


def pairwise_kappa(long: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """(a, b, n, kappa, positive_agreement) of all pairs of people, over the cells (item, label) that either of the pair could give.

    long: (item, person, label). The cells of a pair are those of the items both have, for every label anybody gave the item.
    people: (item, person) of all who were asked, those who gave no label included; without it, those in long.
    """
    people = (long if people is None else people).select("item", "person").distinct()
    cells = long.select("item", "label").filter("label IS NOT NULL").distinct().join(people, "item")
    said = long.filter("label IS NOT NULL").select("item", "person", "label").distinct().withColumn("y", F.lit(1))
    votes = cells.join(said, ["item", "person", "label"], "left").fillna(0, "y")
    a, b = (votes.select("item", "label", F.col("person").alias(x), F.col("y").alias(f"y_{x}")) for x in ("a", "b"))
    both = a.join(b, ["item", "label"]).filter("a < b")
    c = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("y_a") * F.col("y_b")).alias("tp"), F.sum("y_a").alias("pa"), F.sum("y_b").alias("pb"), F.count_if(F.col("y_a") == F.col("y_b")).alias("same"))
    n = F.col("n").cast("double")
    pe = (F.col("pa") * F.col("pb") + (n - F.col("pa")) * (n - F.col("pb"))) / (n * n)
    return c.select("a", "b", "n", F.round(F.when(pe >= 1, 1.0).otherwise((F.col("same") / n - pe) / (1 - pe)), 4).alias("kappa"), F.round(_safe(2 * F.col("tp"), F.col("pa") + F.col("pb")), 4).alias("positive_agreement"))


def merge_labels(long: DataFrame, n_people: DataFrame | None = None) -> DataFrame:
    """(item, n_people, agreed, disputed): labels that all of the item's people gave, and those that some gave, sorted; both empty where nobody gave any."""
    n = n_people if n_people is not None else long.groupBy("item").agg(F.count_distinct("person").alias("n_people"))
    each = long.filter("label IS NOT NULL").groupBy("item", "label").agg(F.count_distinct("person").alias("c")).join(n, "item", "right")
    return each.groupBy("item", "n_people").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") == F.col("n_people"), F.col("label")))), "|").alias("agreed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("c") < F.col("n_people"), F.col("label")))), "|").alias("disputed"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("c"))


def partition_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n_compared, ari, nmi): two partitions of the rows that have both; nmi by the arithmetic mean."""
    c = contingency(df, a, b)
    pairs = lambda x: x * (x - 1) / 2
    rows, cols = c.groupBy("a").agg(F.sum("c").alias("c")), c.groupBy("b").agg(F.sum("c").alias("c"))
    one = c.agg(F.sum("c").alias("n"), F.sum(pairs(F.col("c"))).alias("s"), F.sum(F.col("c") * F.log("c")).alias("hc"))
    for side, t in (("r", rows), ("k", cols)):
        one = one.crossJoin(F.broadcast(t.agg(F.sum(pairs(F.col("c"))).alias(f"s{side}"), F.sum(F.col("c") * F.log("c")).alias(f"h{side}"))))
    n = F.col("n")
    expected = F.col("sr") * F.col("sk") / pairs(n)
    top = (F.col("sr") + F.col("sk")) / 2
    h_r, h_k, h_c = F.log(n) - F.col("hr") / n, F.log(n) - F.col("hk") / n, F.log(n) - F.col("hc") / n
    mutual = h_r + h_k - h_c
    return one.select(n.cast("long").alias("n_compared"), F.round(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)), 6).alias("ari"), F.round(F.when(h_r + h_k <= 1e-12, 1.0).otherwise(2 * mutual / (h_r + h_k)), 6).alias("nmi"))


def most_confused(long: DataFrame, n: int = 10) -> DataFrame:
    """(label_a, label_b, items): pairs of different labels that people gave the same item, the n most frequent."""
    a, b = (long.select("item", F.col("label").alias(x)).distinct() for x in ("label_a", "label_b"))
    return a.join(b, "item").filter("label_a < label_b").groupBy("label_a", "label_b").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "label_a", "label_b").limit(n)


def first_evidence(long: DataFrame, order: list[str]) -> DataFrame:
    """(item, label, …): of several annotations of one label, the first by `order`."""
    rest = [c for c in long.columns if c not in ("item", "label")]
    return long.groupBy("item", "label").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x")).select("item", "label", "x.*")


def span_faults(df: DataFrame, key: str, text: str, annotations: str) -> DataFrame:
    """(key, skill_id, fault) of annotations whose span doesn't hold their evidence: 'outside' the text or 'differs'."""
    a = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.explode(annotations).alias("a"))
    cut = F.substring(F.col("t"), F.col("a.start") + 1, F.greatest(F.col("a.end") - F.col("a.start"), F.lit(0)))
    fault = F.when((F.col("a.start") < 0) | (F.col("a.end") > F.length("t")) | (F.col("a.end") <= F.col("a.start")), "outside").when(cut != F.col("a.evidence"), "differs")
    return a.select(F.col("k").alias(key), F.col("a.skill_id").alias("skill_id"), fault.alias("fault")).filter("fault IS NOT NULL")


def split_by_hash(id_, salt: str = "gold-split-v1:"):
    """holdout or tune by the parity of the hash of salt and id."""
    return F.when(F.conv(F.substring(F.sha2(F.concat(F.lit(salt), id_), 256), 1, 8), 16, 10).cast("long") % 2 == 0, "holdout").otherwise("tune")


def hash_sample(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """The n rows whose hash of salt and key is lowest, with their rank."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key)), 256)
    top = df.withColumn("_h", h).orderBy("_h", key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("_h", key))).drop("_h")


def batched_sample(df: DataFrame, key: str, n: int, shared: int, batches: int, salt: str) -> DataFrame:
    """The n rows of lowest hash, dealt anew by a second hash: the first `shared` as batch K, for all people, the others as B1 to B<batches>."""
    top = hash_sample(df, key, n, salt).drop("rank")
    h = F.sha2(F.concat(F.lit(f"order-{salt}"), F.col(key)), 256)
    r = F.row_number().over(Window.orderBy(h, key))  # over the n rows of the sample
    size = F.lit(max(1, -(-(n - shared) // batches)))
    return top.withColumn("_r", r).withColumn("batch", F.when(F.col("_r") <= shared, "K").otherwise(F.concat(F.lit("B"), F.ceil((F.col("_r") - shared) / size).cast("string")))).drop("_r")


def reviewed(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """(item, label, start, end) after review: labels (item, label, start, end) and decisions (item, label, action, new_label, start, end).

    keep, or no decision, leaves a label; fix moves it; replace renames it; reject drops it; add puts one in. Of one label several times in
    an item the first place counts.
    """
    d = decisions.select("item", "label", "action", "new_label", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    old = labels.join(d.filter("action <> 'add'"), ["item", "label"], "left").filter("action IS NULL OR action <> 'reject'")
    moved = F.coalesce(F.col("action").isin("fix", "replace"), F.lit(False))
    kept = old.select("item", F.when(F.col("action") == "replace", F.col("new_label")).otherwise(F.col("label")).alias("label"), F.when(moved, F.coalesce("d_start", "start")).otherwise(F.col("start")).alias("start"), F.when(moved, F.coalesce("d_end", "end")).otherwise(F.col("end")).alias("end"))
    added = d.filter("action = 'add'").select("item", "label", F.col("d_start").alias("start"), F.col("d_end").alias("end"))
    return first_evidence(kept.unionByName(added), ["start", "end"])


def gold_candidates(jobs: DataFrame, known: DataFrame, title: str, least_chars: int = 150, n: int = 50) -> DataFrame:
    """The n shortest postings fit for labelling: title by the pattern, texts of some length, unlike known postings and each other by half of their shingles."""
    from jobweave.operators.duplicates import greedy, shingle_likes

    fit = jobs.filter(F.col("raw_job_title").rlike(title) & (F.length("job_description") >= least_chars))
    fit = fit.join(known.select("job_id").distinct(), "job_id", "left_anti").join(known.select("source_url").filter("source_url IS NOT NULL").distinct(), "source_url", "left_anti")
    # Known ones first, then by length and id: the order in which the greedy choice goes.
    order = F.concat(F.lpad(F.length("job_description").cast("string"), 9, "0"), F.lit(":"), F.col("job_id"))
    both = known.select(F.concat(F.lit("0:"), "job_id").alias("k"), "job_description").unionByName(fit.select(F.concat(F.lit("1:"), order).alias("k"), "job_description"))
    like, classes = shingle_likes(both, "k", "job_description", 0.5)
    repeated, copies = greedy(like.select("a", "b")).select(F.col("b").alias("k")), classes.filter("k <> representative").select("k")
    return fit.withColumn("k", F.concat(F.lit("1:"), order)).join(repeated.unionByName(copies).distinct(), "k", "left_anti").orderBy("k").limit(n).drop("k")
