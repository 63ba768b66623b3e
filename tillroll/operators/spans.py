"""Words to spans: BIO islands, boundary repair and assignment, all as windows over one document's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import labels as L
from tillroll.functions import schema as S


def in_document():
    """A document's words in order."""
    return Window.partitionBy("doc_id").orderBy("word_idx")


def _texts(order: str = "word_idx") -> Column:
    """Aggregate: the words of a group in order, joined by a space."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")


def islands(words: DataFrame, label: str, *breaks: str) -> DataFrame:
    """Adds field, island and orphan: runs of one field that B- labels, other fields and the break columns end."""
    field = L.label_field(F.col(label))
    out = words.withColumn("field", field)
    before = F.lag("field").over(in_document())
    same = before.eqNullSafe(F.col("field"))
    for name in breaks:
        same = same & F.lag(name).over(in_document()).eqNullSafe(F.col(name))
    inside = ~F.col(label).startswith("I-")
    out = out.withColumn("starts", (F.col("field") != "O") & (inside | ~same)).withColumn("orphan", F.col(label).startswith("I-") & ~same)
    return out.withColumn("island", F.sum(F.col("starts").cast("int")).over(in_document())).where("field <> 'O'")


def bio_spans(words: DataFrame, label: str = "pred_label", *breaks: str) -> DataFrame:
    """Spans of words(doc_id, word_idx, text, label, confidence, x0, y0, x1, y1), one row each, with dense span_id."""
    group = islands(words, label, *breaks).groupBy("doc_id", "island").agg(
        F.first("field").alias("field"),
        F.min("word_idx").alias("first_word"),
        F.max("word_idx").alias("last_word"),
        F.count("*").alias("n_words"),
        _texts().alias("raw_text"),
        F.avg("confidence").alias("confidence"),
        F.min("confidence").alias("confidence_min"),
        F.max("orphan").alias("orphan"),
        *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.max, "page_w"), (F.max, "page_h"), (F.min, "line_no"))],
    )
    dense = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_word")) - 1
    return group.withColumn("span_id", dense).withColumn("text", L.span_text(F.col("field"), F.col("raw_text"))).drop("island")


def _middle(p: str = "") -> Column:
    return (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2


def repair_bio(words: DataFrame, label: str = "pred_label", gap: float = 3.0, drift: float = 0.6) -> DataFrame:
    """Adds repaired: B-X after X becomes I-X on the same line with a small gap.

    Heads of sums and payment stay apart, and prices unless a currency sign or joiner stands before.
    """
    with_field = words.withColumn("field", L.label_field(F.col(label)))
    lag = lambda c: F.lag(c).over(in_document())
    taller = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"), lag("y1") - lag("y0"))
    near_line = F.coalesce(lag("line_no") == F.col("line_no"), F.abs((lag("y0") + lag("y1")) / 2 - _middle()) <= taller * drift)
    joined = ~F.col("field").isin(*S.PRICE_FIELDS) | F.trim(lag("text")).isin("$", "Y", "EUR", "GBP", "-", ".")
    apart = F.col("field").isin(*S.SUMMARY_HEADS, "PAYMENT_METHOD")
    merge = F.col(label).startswith("B-") & (F.col("field") != "O") & (lag("field") == F.col("field")) & ~apart & joined & near_line & (F.col("x0") - lag("x1") <= taller * gap)
    return with_field.withColumn("repaired", F.when(merge, F.concat(F.lit("I-"), F.col("field"))).otherwise(F.col(label))).drop("field")


def assign_adjacent(words: DataFrame, field: str = "field") -> DataFrame:
    """Adds label: I if the word before has the same field, stands on the same line and near; else B."""
    lag = lambda c: F.lag(c).over(in_document())
    taller = F.greatest(F.col("y1") - F.col("y0"), lag("y1") - lag("y0"))
    level = F.abs((lag("y0") + lag("y1")) / 2 - _middle()) <= 0.6 * taller
    goes_on = (lag(field) == F.col(field)) & level & (F.col("x0") - lag("x1") <= 3.0 * taller)
    return words.withColumn("label", F.when(F.col(field) == "O", "O").when(goes_on, F.concat(F.lit("I-"), F.col(field))).otherwise(F.concat(F.lit("B-"), F.col(field))))


def assign_by_field(words: DataFrame, field: str = "field") -> DataFrame:
    """Adds label: I if the last word of the same field, wherever it was, is on the same line; else B."""
    last = Window.partitionBy("doc_id", field).orderBy("word_idx")
    lag = lambda c: F.lag(c).over(last)
    lower = F.least(F.col("y1") - F.col("y0"), lag("y1") - lag("y0"))
    level = F.abs((lag("y0") + lag("y1")) / 2 - _middle()) <= F.greatest(F.lit(8.0), 0.65 * lower)
    return words.withColumn("label", F.when(F.col(field) == "O", "O").when(level, F.concat(F.lit("I-"), F.col(field))).otherwise(F.concat(F.lit("B-"), F.col(field))))


def recompute_bio(words: DataFrame, field: str = "field", row: str = "line_no") -> DataFrame:
    """Adds label: B where the field or the row changes."""
    same = (F.lag(field).over(in_document()) == F.col(field)) & (F.lag(row).over(in_document()) == F.col(row))
    return words.withColumn("label", F.when(F.col(field) == "O", "O").when(same, F.concat(F.lit("I-"), F.col(field))).otherwise(F.concat(F.lit("B-"), F.col(field))))


def segments(words: DataFrame, key: str) -> DataFrame:
    """Adds segment, counted up where key changes, and position, from 2 on in each segment."""
    change = ~F.lag(key).over(in_document()).eqNullSafe(F.col(key)) & (F.row_number().over(in_document()) > 1)
    out = words.withColumn("segment", F.sum(F.when(change, 1).otherwise(0)).over(in_document()))
    return out.withColumn("position", F.row_number().over(Window.partitionBy("doc_id", "segment").orderBy("word_idx")) + 1)


def chunks(words: DataFrame, size: int = 510) -> DataFrame:
    """Adds chunk and place: consecutive runs of so many words of a document."""
    k = F.row_number().over(in_document()) - 1
    return words.withColumn("k", k).withColumn("chunk", F.floor(F.col("k") / size)).withColumn("place", F.col("k") % size).drop("k")


def row_clusters(words: DataFrame, together: bool = False) -> DataFrame:
    """doc_id, word_idx and row_id: words by height joined to the first row whose running mean is near.

    The order decides; documents are worked on many at a time, see pages.rows(). together: see pages.by_document().
    """
    from tillroll.operators import pages

    return pages.by_document(words.select("doc_id", "word_idx", "x0", "y0", "y1"), pages.rows, pages.ROW_IDS, together)


def bio_violations(words: DataFrame, label: str, *same: str) -> DataFrame:
    """Words whose I- label does not follow its own field, within the same of further columns."""
    field = F.regexp_replace(F.col(label), "^[BI]-", "")
    keyed = words.withColumn("_field", field)
    follows = F.lag("_field").over(in_document()).eqNullSafe(F.col("_field"))
    for name in same:
        follows = follows & F.lag(name).over(in_document()).eqNullSafe(F.col(name))
    return keyed.withColumn("_bad", F.col(label).startswith("I-") & ~follows).where("_bad").drop("_bad", "_field")


def context_nodes(words: DataFrame, spans: DataFrame, mode: str = "o_only") -> DataFrame:
    """Graph nodes: spans first, then words as context (all, o_only: those of no span, none), with dense node_id."""
    if mode not in ("all", "o_only", "none"):
        raise ValueError(f"mode {mode!r}")
    nodes = spans.select("doc_id", F.lit("SPAN").alias("kind"), F.col("span_id").alias("place"), "field", "text")
    if mode != "none":
        extra = words
        if mode == "o_only":
            owned = spans.select("doc_id", F.explode(F.sequence("first_word", "last_word")).alias("word_idx"))
            extra = words.join(owned, ["doc_id", "word_idx"], "left_anti")
        nodes = nodes.unionByName(extra.select("doc_id", F.lit("TOKEN").alias("kind"), F.col("word_idx").alias("place"), F.lit("CONTEXT_TOKEN").alias("field"), "text"))
    return nodes.withColumn("node_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "place")) - 1)


def pool(df: DataFrame, vector: str, order: str, *keys: str, mode: str = "mean") -> DataFrame:
    """By key, one vector for all rows and their number n: the first by order, or the mean of each position.

    A shorter vector counts for the positions that it has, a null or empty one for n only; keys with no other have null.
    """
    if mode == "first":
        return df.groupBy(*keys).agg(F.min_by(vector, order).alias("vector"), F.count("*").alias("n"))
    if mode != "mean":
        raise ValueError(f"no such mode of pooling: {mode}")
    each = df.select(*keys, F.posexplode_outer(vector).alias("place", "value")).groupBy(*keys, "place").agg(F.avg("value").alias("value"), F.count("*").alias("rows"))
    held = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "value"))))
    made = each.groupBy(*keys).agg(held.alias("held"), F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, F.col("rows")).otherwise(0)).alias("n"))
    return made.select(*keys, F.when(F.size("held") > 0, F.col("held.value")).alias("vector"), "n")
