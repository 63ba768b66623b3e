"""Splits, samples, repeats and set operations. Where a seeded shuffle would decide, a hash or the id does."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_cut(ids: DataFrame, key: str, take: int, n: int, within: int = 10_000) -> object:
    """The take-th greatest of n distinct numbers. An approximate quantile on either side leaves about one in so many to
    sort, so no task sorts them all."""
    low, high = ids.agg(F.percentile_approx(key, [max(0.0, 1 - take / n - 2 / within), min(1.0, 1 - take / n + 2 / within)], within)).first()[0]
    above = ids.where(F.col(key) > F.lit(high)).count()
    if above >= take:  # not within the quantile's stated error
        low, high, above = high, None, 0
    some = ids.where((F.col(key) >= F.lit(low)) & ((F.col(key) <= F.lit(high)) if high is not None else F.lit(True)))
    found = some.orderBy(F.desc(key)).limit(take - above).agg(F.min(key), F.count("*")).first()
    return found[0] if found[1] == take - above else ids.orderBy(F.desc(key)).limit(take).agg(F.min(key)).first()[0]


def tail_split(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Adds split: the last ids, half-even of ratio but one at least and not all, are validation. Ids are numbers."""
    ids = df.select(key).distinct()
    n = ids.count()
    take = min(max(round(n * ratio), 1), max(n - 1, 0))
    cut = rank_cut(ids, key, take, n) if take else None
    return df.withColumn("split", F.when(F.col(key) >= F.lit(cut), "validation").otherwise("train") if take else F.lit("train"))


def parent_split(df: DataFrame, parent: str, augmented: Column, count: int) -> DataFrame:
    """Adds split: the last count parents are validation without their augmented rows, which are dropped; the rest train."""
    last = df.select(parent).distinct().orderBy(F.desc(parent)).limit(count).agg(F.min(parent)).first()[0]
    out = df.withColumn("split", F.when(F.col(parent) >= F.lit(last), "validation").otherwise("train"))
    return out.where(~((F.col("split") == "validation") & augmented))


def balanced_sample(df: DataFrame, group: str, augmented: Column, order: str, n: int) -> DataFrame:
    """n rows: originals first, then the k-th augmented row of every group for k = 0, 1, ..."""
    marked = df.withColumn("_aug", augmented.cast("int"))
    ranked = marked.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_aug").orderBy(order)))
    return ranked.orderBy("_aug", F.when(F.col("_aug") == 1, F.col("_k")).otherwise(0), group, order).limit(n).drop("_aug", "_k")


def cover_labels(df: DataFrame, label: str, split: str, least: int, order: str) -> DataFrame:
    """Moves train rows to validation, in order, until each label has so many there.

    order tells the rows of a label apart. A label's first rows are found before any shuffle, so many from each task, and
    only they are ranked; they are as many as labels times least, which is why they may be sent to all.
    """
    have = df.groupBy(label).agg(F.count_if(F.col(split) == "validation").alias("_have"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    first = df.where(F.col(split) == "train").select(label, order).withColumn("_k", rank).where(F.col("_k") <= least)
    moved = first.join(have, label).where(F.col("_k") <= least - F.col("_have")).select(label, order, F.lit(True).alias("_moved"))
    joined = df.join(F.broadcast(moved), [label, order], "left")
    return joined.withColumn(split, F.when(F.col("_moved") & (F.col(split) == "train"), "validation").otherwise(F.col(split))).select(*df.columns)


def oversample(df: DataFrame, times: Column) -> DataFrame:
    """Each row times times, with repeat from 0."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), times - 1))).where(times > 0)


def capped(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def frequent(df: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """The n commonest texts, each with its first row."""
    return df.groupBy(text).agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), text).limit(n)


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Union by name of sources whose columns may differ, with source."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of either side, with both, left or right by where they are."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def seeded_split(df: DataFrame, key: str, validation: int, test: int, seed: int = 42) -> DataFrame:
    """Adds split: the first test keys in order of a hash with the seed, then the validation ones, the rest train.

    Of one or two keys all train; else two are left for train and validation, and one for train.
    """
    ids = df.select(key).distinct()
    n = ids.count()
    test = max(0, min(test, n - 2)) if n > 2 else 0
    validation = max(0, min(validation, n - test - 1)) if n > 2 else 0
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    first = ids.withColumn("_h", order).orderBy("_h").limit(test + validation)
    ranked = first.withColumn("_k", F.row_number().over(Window.orderBy("_h"))).select(key, F.when(F.col("_k") <= test, "test").otherwise("validation").alias("split"))
    return df.join(F.broadcast(ranked), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def of_splits(df: DataFrame, mapping: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Rows whose split, train where mapping(key, split) has none, is wanted."""
    return df.join(mapping.select(key, "split"), key, "left").withColumn("split", F.coalesce("split", F.lit("train"))).where(F.col("split").isin(*wanted))


def outside(df: DataFrame, path: str, names: list[str]) -> DataFrame:
    """Rows whose path has none of these as one of its parts."""
    return df.where(~F.arrays_overlap(F.split(F.col(path), "/"), F.array(*map(F.lit, names))))


def listed(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key a manifest lists."""
    return df.join(manifest.select(key).distinct(), key, "left_semi")


def checked_union(*sources: DataFrame) -> DataFrame:
    """The rows of all sources, which must have the same columns of the same types in any order."""
    for df in sources[1:]:
        if dict(df.dtypes) != dict(sources[0].dtypes):
            raise ValueError(f"columns differ: {sorted(set(df.dtypes) ^ set(sources[0].dtypes))}")
    return reduce(DataFrame.unionByName, sources)


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of two readings that differ at a place: doc_id, word_idx, left_text and right_text, null where one has none."""
    a, b = left.select("doc_id", "word_idx", F.col("text").alias("left_text")), right.select("doc_id", "word_idx", F.col("text").alias("right_text"))
    return a.join(b, ["doc_id", "word_idx"], "full_outer").where(~F.col("left_text").eqNullSafe(F.col("right_text")))
