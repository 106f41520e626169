"""A sample that stays as it is when records are added.

Every record has a persistent sequence number, which a `Registry` gives and keeps; it is selected when the fractional part of
number x golden ratio + shift lies in a fixed interval. Consecutive numbers fall evenly into the interval at every size.
Where nothing can be kept, `stable_sample` takes the id's own number instead: as stable, but only as even as a hash sample.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.llm.common import cut
from jobweave.plans.staging import dropped, file_system

# Fixed value: the golden ratio's fractional part in units of 2**-64, as a signed 64-bit number (odd).
GOLDEN = 0x9E3779B97F4A7C15 - 2**64


def plain_id(c: Column) -> Column:
    """One spelling of an id: without outer blanks of any kind or unseen characters, in lower case; '' becomes null."""
    s = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$|\p{Cf}", ""))
    return F.when(s != "", s)


def plain_stratum(c: Column) -> Column:
    return F.coalesce(plain_id(c), F.lit("(none)"))


def number_of(id_: Column) -> Column:
    """The number a plain hexadecimal id of up to 16 digits is; any other id gives its hash."""
    hexa = id_.rlike("^[0-9a-f]{1,16}$")
    high, low = (F.conv(F.substring(F.lpad(id_, 16, "0"), a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.when(hexa, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(F.xxhash64(id_))


def place(number: Column, stratum: Column | None = None, seed: int = 0) -> Column:
    """Where in [0, 1) a sequence number falls; each stratum has a fixed shift of its own."""
    # 64-bit products wrap round, which is the fractional part; a product by parts stays exact under ANSI rules.
    m = 2**32
    glow, ghigh = (GOLDEN % 2**64) % m, (GOLDEN % 2**64) // m
    low, high = number.bitwiseAND(F.lit(m - 1)), F.shiftrightunsigned(number, 32)
    mid = F.pmod(_times(low, ghigh) + _times(high, glow), F.lit(m))
    # low * glow needs 64 bits: its upper half by two 16-bit steps.
    upper, lower = F.shiftrightunsigned(low, 16), low.bitwiseAND(F.lit(0xFFFF))
    a, b = upper * F.lit(glow >> 16), lower * F.lit(glow & 0xFFFF)
    c, d = upper * F.lit(glow & 0xFFFF), lower * F.lit(glow >> 16)
    carry = F.shiftrightunsigned(F.shiftrightunsigned(b, 16) + (c.bitwiseAND(F.lit(0xFFFF))) + (d.bitwiseAND(F.lit(0xFFFF))), 16)
    top = a + F.shiftrightunsigned(c, 16) + F.shiftrightunsigned(d, 16) + carry
    frac = F.pmod(top + mid, F.lit(m)) / F.lit(float(m))
    shift = F.xxhash64(F.lit(seed), *([stratum] if stratum is not None else [])).bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))
    return (frac + shift) % 1.0


def _times(x: Column, k: int) -> Column:
    """x * k mod 2**32 for x, k under 2**32, without leaving 63 bits."""
    m = F.lit(2**32)
    return F.pmod(F.pmod(x * F.lit(k >> 16), m) * F.lit(65536) + x * F.lit(k & 0xFFFF), m)


def stable_sample(df: DataFrame, key: str, share: float, stratum: str | None = None, number: str | None = None, seed: int = 0) -> DataFrame:
    """Rows (key, stratum) of the sample, one for each id and stratum, with the id in its plain spelling.

    The same ids give the same sample however they are spelled, ordered, repeated or partitioned; selected ids stay
    when rows are added. Null and blank ids aren't sampled; a missing or blank stratum is '(none)'. number names a column with
    persistent numbers, of which the least counts where an id has several and null ones none; without it an id's own number is taken.
    """
    s = plain_stratum(df[stratum]) if stratum else F.lit("(all)")
    rows = df.select(plain_id(df[key]).alias("k"), s.alias("s"), (df[number].cast("long") if number else F.lit(None).cast("long")).alias("q")).filter("k IS NOT NULL")
    if number:
        rows = rows.filter("q IS NOT NULL").groupBy("k", "s").agg(F.min("q").alias("q"))
        return rows.filter(place(F.col("q"), F.col("s"), seed) < share).select(F.col("k").alias(key), F.col("s").alias("stratum"))
    return rows.filter(place(number_of(F.col("k")), F.col("s"), seed) < share).select(F.col("k").alias(key), F.col("s").alias("stratum")).distinct()


def number_new(registry: DataFrame, incoming: DataFrame, key: str, stratum: str, order: str | None = None) -> DataFrame:
    """The registry (key, stratum, number) with the incoming ids that it lacks, numbered on from the largest of their stratum.

    Numbers once given never change, so a sample over them keeps its members. New ids are numbered by their least `order` (as text, missing ones last), as postings by
    the time they arrived, then by id; that does not depend on partitions. Null and blank ids get none.
    """
    at = F.coalesce(incoming[order].cast("string"), F.lit("\U0010ffff")) if order else F.lit("")
    new = incoming.select(plain_id(incoming[key]).alias(key), plain_stratum(incoming[stratum]).alias(stratum), at.alias("_at")).dropna().groupBy(key, stratum).agg(F.min("_at").alias("_at"))
    new = new.join(registry.select(key, stratum), [key, stratum], "left_anti")
    # In ranges of the whole order; within each by itself, and before it the counts of those before.
    n = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(new.repartitionByRange(n, stratum, "_at", key).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(stratum, "_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(stratum).orderBy("_p")) - F.col("_n")).drop("_n")
    top = registry.groupBy(stratum).agg(F.max("number").alias("_top"))
    rank = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy("_at", key))
    numbered = dealt.withColumn("_r", rank).join(before, [stratum, "_p"]).join(top, stratum, "left")
    return registry.select(key, stratum, "number").unionByName(numbered.select(key, stratum, (F.coalesce("_top", F.lit(-1)) + F.col("_before") + F.col("_r")).cast("long").alias("number")))


class Registry:
    """Persistent sequence numbers (key, stratum, number), in a folder that outlives the run: one written table for each time new ids came."""

    def __init__(self, spark: SparkSession, path: str, key: str, stratum: str = "stratum"):
        self.spark, self.path, self.key, self.stratum = spark, path.rstrip("/"), key, stratum
        self._fs, self._at = file_system(spark, self.path)
        self._fs.mkdirs(self._at(self.path))

    def _parts(self) -> list[str]:
        return sorted(x.getPath().toString() for x in self._fs.listStatus(self._at(self.path)) if x.getPath().getName().startswith("part-"))

    def numbers(self) -> DataFrame:
        schema = f"{self.key} string, {self.stratum} string, number long"
        parts = self._parts()
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def numbered(self, df: DataFrame, key: str, stratum: str | None = None, order: str | None = None) -> DataFrame:
        """The numbers after those of df's ids that had none are given and kept. A table is complete once it has its name; two writers at once are an error."""
        s = df[stratum] if stratum else F.lit("(all)")
        rows = df.select(df[key].alias(self.key), s.alias(self.stratum), (df[order] if order else F.lit(None).cast("string")).alias("_order"))
        known = self.numbers()
        more = cut(number_new(known, rows, self.key, self.stratum, "_order").join(known.select(self.key, self.stratum), [self.key, self.stratum], "left_anti"))
        if not more.isEmpty():
            temporary, n = f"{self.path}/_{uuid.uuid4().hex}", len(self._parts())
            more.write.parquet(temporary)
            if not self._fs.rename(self._at(temporary), self._at(f"{self.path}/part-{n:06d}")):
                raise OSError(f"{self.path} was written by another at the same time")
        dropped(more)
        return self.numbers()

    def sample(self, df: DataFrame, key: str, share: float, stratum: str | None = None, order: str | None = None, seed: int = 0) -> DataFrame:
        """Rows (key, stratum) of the sample among df's ids: those whose number falls into the interval."""
        numbers = self.numbered(df, key, stratum, order)
        s = plain_stratum(df[stratum]) if stratum else F.lit("(all)")
        mine = df.select(plain_id(df[key]).alias(self.key), s.alias(self.stratum)).dropna().distinct()
        picked = numbers.filter(place(F.col("number"), F.col(self.stratum), seed) < share)
        return mine.join(picked, [self.key, self.stratum]).select(F.col(self.key).alias(key), F.col(self.stratum).alias("stratum"))


def evenness(numbers: DataFrame, share: float, sizes: list[int], stratum: str = "stratum", seed: int = 0) -> DataFrame:
    """(stratum, size, selected, expected) of the first numbers of each stratum, at each of the sizes up to its own."""
    last = numbers.groupBy(stratum).agg(F.max("number").alias("_last"))
    picked = place(F.col("number"), F.col(stratum), seed) < share
    at = numbers.select(stratum, "number", picked.alias("_in"), F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter("number < size")
    return at.groupBy(stratum, "size").agg(F.count_if("_in").alias("selected")).join(last, stratum).filter("size <= _last + 1").select(stratum, F.col("size").cast("long").alias("size"), "selected", (F.col("size") * share).alias("expected"))
