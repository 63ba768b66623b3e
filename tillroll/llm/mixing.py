"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, rate_s = target share * target size / documents of s. The
count inverts the distribution at a uniform number hashed from the document's id, its text and a seed, so a rerun, a
retried task or another partitioning gives the same mix. No task sees a source's documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest rate that one inversion serves; beyond it the rate is split evenly over several independent hashes, since
#: a sum of Poisson numbers is one of the summed rate.
STEP = 16.0
#: Terms of one inversion; beyond them the tail of Poisson(STEP) is under 1e-16, less than a hash can tell.
TERMS = 80
SEED = 17
#: Sources, at under a kilobyte each, whose table is broadcast; with more of them the join is shuffled and salted.
BROADCAST_SOURCES, SALTS = 4096, 64
#: Exponent on source sizes of the default target: 1 keeps the corpus's shares, 0 makes all sources equal.
TEMPER = 0.5


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None) -> DataFrame:
    """source, n and rate, the mean repetitions of a document of it; a row for each source, null being one.

    weights: the target share of each source, made to sum to one; a source that it lacks gets none. Without it shares go
    by the sources' sizes to the power TEMPER. size: documents of the mix, by default those of the corpus.
    """
    counted = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(TEMPER))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0)).cast("double") if weights else F.lit(0.0)
    counted = counted.withColumn("share", share)
    whole = counted.agg(F.sum("share").alias("shares"), F.sum("n").alias("total"))
    target = F.lit(float(size)) if size is not None else F.col("total").cast("double")
    return counted.crossJoin(F.broadcast(whole)).select("source", "n", F.when(F.col("shares") > 0, target * F.col("share") / F.col("shares") / F.col("n")).otherwise(F.lit(0.0)).alias("rate"))


def _thresholds(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... TERMS - 1."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))
    add = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * rate / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add, lambda a: a["cdf"])


def poisson_copies(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, seed: int = SEED) -> DataFrame:
    """row (the input row as a struct), rate and n_copies for each row of docs, those with no copy included.

    Rows that repeat both doc_id and text draw the same number. A null source is a source; a null doc_id or text hashes
    as a value of its own. An empty table gives no rows.
    """
    table = rates(docs, weights, size).withColumn("streams", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    table = table.select(F.col("source").alias("_s"), "rate", "streams", _thresholds(F.col("rate") / F.col("streams")).alias("cdf"))
    packed = docs.select(F.struct("*").alias("row"), F.md5(F.col("text").cast("binary")).alias("digest"))
    of = lambda name: F.col("row")[name]
    drawn = lambda k: F.size(F.filter(F.col("cdf"), lambda p: p <= uniform(F.lit(seed), k, of("doc_id"), F.col("digest"))))
    same = of("source").cast("string").eqNullSafe(F.col("_s"))
    few = table.limit(BROADCAST_SOURCES + 1).collect()
    if len(few) <= BROADCAST_SOURCES:
        joined = packed.join(F.broadcast(docs.sparkSession.createDataFrame(few, table.schema)), same)
    else:  # too many sources to send everywhere: a shuffled join, in which each source has SALTS keys
        salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = packed.withColumn("salt", F.pmod(F.xxhash64(of("doc_id"), F.col("digest")), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("_salt")))
    copies = F.aggregate(F.sequence(F.lit(0), F.col("streams") - 1), F.lit(0), lambda acc, k: acc + drawn(k))
    return joined.select("row", "rate", copies.alias("n_copies"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, seed: int = SEED) -> DataFrame:
    """The mix: the columns of docs, each row as often as drawn, dealt to partitions at random by hash and shuffled inside each."""
    copies = poisson_copies(docs, weights, size, seed).where("n_copies > 0")
    dealt = copies.select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    key = F.xxhash64(F.lit(seed), F.col("row")["doc_id"], F.col("row")["text"], F.col("copy"))
    keyed = dealt.select("row", key.alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").select("row.*")
