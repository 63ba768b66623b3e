"""Lines, crops and boxes of a page: roll-ups of words to lines and blocks, words of a line's quad, rescaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import geometry as G
from tillroll.operators.spans import in_document

_BOX = ("x0", "y0", "x1", "y1")


def with_line_box(words: DataFrame, line: str = "line_no") -> DataFrame:
    """Adds line_x0 to line_y1, the box around all words of a word's line."""
    of = Window.partitionBy("doc_id", line)
    return words.withColumns({f"line_{c}": (F.min if c in ("x0", "y0") else F.max)(c).over(of) for c in _BOX})


def line_rollup(words: DataFrame, line: str = "line_no") -> DataFrame:
    """By line: its text, words in order joined by a space, their number, and the box around the valid ones."""
    parts = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    made = words.groupBy("doc_id", line).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.count("*").alias("n_words"), G.union(*map(F.col, _BOX)).alias("box"))
    return made.select("doc_id", line, "text", "n_words", *[F.col("box")[k].alias(c) for k, c in enumerate(_BOX)])


def block_rollup(lines: DataFrame, block: str, line: str = "line_no") -> DataFrame:
    """By block: its lines' texts in order, one below the other, and the box around them."""
    parts = F.array_sort(F.collect_list(F.struct(line, "text")))
    made = lines.groupBy("doc_id", block).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("n_lines"), G.union(*map(F.col, _BOX)).alias("box"))
    return made.select("doc_id", block, "text", "n_lines", *[F.col("box")[k].alias(c) for k, c in enumerate(_BOX)])


def word_quads(lines: DataFrame) -> DataFrame:
    """The words of lines(..., text, quad) with place and a quad each: the share of the line's top and bottom edges that
    their characters have in the text."""
    words = F.split("text", r"\s")
    starts = lambda k: F.aggregate(F.slice(words, 1, k), F.lit(0), lambda a, w: a + F.length(w) + 1)
    found = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.struct(F.element_at(words, k).alias("word"), starts(k - 1).alias("start")))
    each = lines.withColumn("_w", F.explode(F.filter(found, lambda w: w["word"] != "")))
    whole = F.length("text").cast("double")
    a, b = F.col("_w.start") / whole, (F.col("_w.start") + F.length("_w.word")) / whole
    at = lambda p, q, share: F.struct(*[(F.col("quad")[p][c] + (F.col("quad")[q][c] - F.col("quad")[p][c]) * share).alias(c) for c in ("x", "y")])
    place = F.row_number().over(Window.partitionBy("doc_id", "line_no").orderBy("_w.start")) - 1
    return each.select("doc_id", "line_no", place.alias("place"), F.col("_w.word").alias("text"), F.array(at(0, 1, a), at(0, 1, b), at(3, 2, b), at(3, 2, a)).alias("quad"))


def line_bio(words: DataFrame, field: str = "field", line: str = "line_no") -> DataFrame:
    """Adds label to words with a valid box, others go: the first one of a line begins its field, the rest go on."""
    fine = words.where(G.valid([F.col(c) for c in _BOX]))
    first = F.row_number().over(Window.partitionBy("doc_id", line, field).orderBy("word_idx")) == 1
    return fine.withColumn("label", F.when(F.col(field) == "O", "O").otherwise(F.concat(F.when(first, "B-").otherwise("I-"), F.col(field))))


def gap_groups(indices: DataFrame, gap: int = 1) -> DataFrame:
    """doc_id, group, first, last and n of runs of word_idx in which neighbours are at most gap apart, not counting them."""
    far = F.coalesce(F.col("word_idx") - F.lag("word_idx").over(in_document()) > gap + 1, F.lit(True))
    marked = indices.select("doc_id", "word_idx").distinct().withColumn("_new", far.cast("int")).withColumn("group", F.sum("_new").over(in_document()) - 1)
    return marked.groupBy("doc_id", "group").agg(F.min("word_idx").alias("first"), F.max("word_idx").alias("last"), F.count("*").alias("n"))


def rescaled(box: list[Column], sx: Column, sy: Column) -> list[Column]:
    """A box or quad's numbers on a page of another size, half-even."""
    return [F.bround(c * (sx if k % 2 == 0 else sy)).cast("int") for k, c in enumerate(box)]


def padded(box: list[Column], padding: int, width: Column, height: Column) -> list[Column]:
    """A crop's box: wider by the padding on every side, inside the page."""
    x0, y0, x1, y1 = box
    return [F.greatest(F.lit(0), x0 - padding), F.greatest(F.lit(0), y0 - padding), F.least(width, x1 + padding), F.least(height, y1 + padding)]
