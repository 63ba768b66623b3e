"""Tables of cells: neighbours along rows and columns, matches of cells by overlap, and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import geometry as G


def adjacency(cells: DataFrame) -> DataFrame:
    """Distinct (table_id, from_cell, to_cell, direction): the next cell to the right and below, over blanks.

    cells(table_id, cell_id, start_row, end_row, start_col, end_col, blank).
    """
    grid = cells.select("table_id", "cell_id", "blank", F.explode(F.sequence("start_row", "end_row")).alias("r"), "start_col", "end_col").select("table_id", "cell_id", "blank", "r", F.explode(F.sequence("start_col", "end_col")).alias("c")).where("NOT blank")

    def following(along: str, across: str, name: str) -> DataFrame:
        after = Window.partitionBy("table_id", across).orderBy(along)
        # Places of one spanning cell follow each other, so the next place of another cell may be further on.
        other = F.lead("cell_id").over(after)
        return grid.withColumn("to_cell", other).where("to_cell IS NOT NULL AND to_cell <> cell_id").select("table_id", F.col("cell_id").alias("from_cell"), "to_cell", F.lit(name).alias("direction"))

    return following("c", "r", "right").unionByName(following("r", "c", "down")).distinct()


def match_cells(truth: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Each cell of the truth with the first found cell, in order of id, that overlaps it enough."""
    box = lambda p: [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
    other = found.select("table_id", *[F.col(c).alias(f"f_{c}") for c in ("cell_id", "x0", "y0", "x1", "y1")])
    joined = truth.join(other, "table_id").withColumn("iou", G.iou(box(""), box("f_"))).where(F.col("iou") >= threshold)
    first = Window.partitionBy("table_id", "cell_id").orderBy("f_cell_id")
    return joined.withColumn("k", F.row_number().over(first)).where("k = 1").select("table_id", "cell_id", "f_cell_id", "iou")


def weighted_f1(scores: DataFrame) -> DataFrame:
    """Mean of f1 by threshold with the thresholds as weights; 0 if nothing matched at some threshold's end."""
    p, r = F.col("tp") / F.col("n_found"), F.col("tp") / F.col("n_truth")
    f1 = F.when((F.col("tp") > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return scores.agg((F.sum(f1 * F.col("threshold")) / F.sum("threshold")).alias("wf1"))
