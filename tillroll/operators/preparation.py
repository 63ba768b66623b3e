"""Recognised items to words: which are words, with boxes on the page, and why others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import geometry as G

_SIDES = ("_left", "_top", "_right", "_bottom")


def prepare_words(items: DataFrame, thousandths: bool = False) -> DataFrame:
    """Adds pixel and thousandth (boxes as arrays), skipped (why an item is no word, else null) and word_idx, dense over the
    words, to items(doc_id, raw_index, text, box, page_w, page_h).

    box: four numbers or null. An item without text is skipped first, then one without a box of positive size, then one
    whose box on the page has none. With thousandths boxes come as thousandths of the page. Texts lose outer blanks.
    """
    page = F.col("page_w"), F.col("page_h")
    fine = F.coalesce(F.size("box") == 4, F.lit(False)) & G.valid(G.box_of(F.col("box")))
    box = G.box_of(F.col("box"))
    if thousandths:
        unit = F.array(*[F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(c).cast("int"))) for c in box])
        made = items.withColumn("thousandth", F.when(fine, unit))
        made = made.withColumn("thousandth", F.when(G.valid(G.box_of(F.col("thousandth"))), F.col("thousandth")))
        made = made.withColumn("pixel", F.when(F.col("thousandth").isNotNull(), G.to_pixels(G.box_of(F.col("thousandth")), *page)))
        outside = F.col("pixel").isNull() | F.col("thousandth").isNull()
    else:
        # Sides are columns of their own, so that what needs no arrays makes none, and nothing is worked out twice.
        made = items.withColumn("_fine", fine)
        made = made.withColumns({c: F.when(F.col("_fine"), v) for c, v in zip(_SIDES, G.clamped(box, *page))})
        sides = [F.col(c) for c in _SIDES]
        made = made.withColumn("pixel", F.when(G.valid(sides), F.array(*sides))).withColumn("thousandth", G.normalise_1000(sides, *page))
        outside, fine = ~F.coalesce(G.valid(sides) & (page[0] > 0) & (page[1] > 0), F.lit(False)), F.col("_fine")
    empty = ~F.coalesce("text", F.lit("")).rlike(r"\S")
    skipped = F.when(empty, "empty_text").when(~fine, "invalid_box").when(outside, "invalid_box_after_clamp")
    made = made.withColumn("skipped", skipped).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    number = F.row_number().over(Window.partitionBy("doc_id", F.col("skipped").isNull()).orderBy("raw_index")) - 1
    return made.withColumn("word_idx", F.when(F.col("skipped").isNull(), number)).drop("_fine", *_SIDES)


def skip_counts(prepared: DataFrame) -> DataFrame:
    """By document: items, words, items skipped for want of text and of a box, and two warnings: many_outside, over two and
    over half of the boxes end beyond the page; maybe_thousandths, none does beyond 1000 on a page of over 1500."""
    why = lambda *names: F.count_if(F.col("skipped").isin(*names))
    boxed = F.col("skipped").isNull() | (F.col("skipped") == "invalid_box_after_clamp")
    outside = F.count_if(boxed & ((F.col("box")[2] > F.col("page_w")) | (F.col("box")[3] > F.col("page_h"))))
    small = (F.max(F.when(boxed, F.array_max("box"))) <= 1000) & (F.max(F.greatest("page_w", "page_h")) > 1500)
    return prepared.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("skipped").isNull()).alias("n_words"),
        why("empty_text").alias("n_empty"),
        why("invalid_box", "invalid_box_after_clamp").alias("n_invalid"),
        (outside > F.greatest(F.lit(2), F.floor(F.count_if(boxed) / 2))).alias("many_outside"),
        F.coalesce(small, F.lit(False)).alias("maybe_thousandths"),
    )
