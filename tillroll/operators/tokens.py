"""Sub-tokens of words: labels and confidences from scores, features of words on their tokens, masked labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Label id that no loss or measure counts.
IGNORED = -100


def best_label(scores: Column) -> Column:
    """The place of the greatest score, the first of equal ones, from 0; null for no scores."""
    return F.when(F.size(scores) > 0, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def confidence(scores: Column) -> Column:
    """The softmax of the greatest score."""
    top = F.array_max(scores)
    return 1 / F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)


def word_predictions(words: DataFrame, tokens: DataFrame, labels: list[str]) -> DataFrame:
    """Adds label and confidence to words(doc_id, word_idx), those of the first of their tokens(doc_id, token_idx, word_idx,
    scores); a word without a token is O with confidence 0."""
    first = tokens.where("word_idx IS NOT NULL").groupBy("doc_id", "word_idx").agg(F.min_by("scores", "token_idx").alias("_scores"))
    name = F.get(F.array(*map(F.lit, labels)), best_label(F.col("_scores")))
    joined = words.join(first, ["doc_id", "word_idx"], "left")
    return joined.withColumn("label", F.when(F.col("_scores").isNull(), "O").otherwise(F.coalesce(name, F.lit("O")))).withColumn("confidence", F.coalesce(confidence(F.col("_scores")), F.lit(0.0))).drop("_scores")


def on_tokens(tokens: DataFrame, words: DataFrame, feature: str, first_only: bool = False) -> DataFrame:
    """Adds a feature of words, an array of numbers, to their tokens; zeros on tokens of no word and, if wanted, on all but
    the first of a word."""
    width = words.agg(F.max(F.size(feature)).alias("_n"))
    joined = tokens.join(words.select("doc_id", "word_idx", feature), ["doc_id", "word_idx"], "left").join(F.broadcast(width))
    first = F.row_number().over(Window.partitionBy("doc_id", "word_idx").orderBy("token_idx")) == 1
    held = F.when(first, F.col(feature)) if first_only else F.col(feature)
    return joined.withColumn(feature, F.coalesce(held, F.array_repeat(F.lit(0.0), F.col("_n")))).drop("_n")


def mask_ignored(tokens: DataFrame, ignored: DataFrame, label: str = "label_id") -> DataFrame:
    """Tokens of ignored(doc_id, word_idx), and those of no word, have the label that nothing counts."""
    marked = tokens.join(ignored.select("doc_id", "word_idx").distinct().withColumn("_out", F.lit(True)), ["doc_id", "word_idx"], "left")
    return marked.withColumn(label, F.when(F.col("_out") | F.col("word_idx").isNull(), IGNORED).otherwise(F.col(label))).drop("_out")
