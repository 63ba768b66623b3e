"""OCR files of any shape to words: JSON lines, tab-separated lines, and pages of nested elements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds k, the place of a line in its block of a file; a task reads a block's lines in order."""
    now, seen = None, 0
    for batch in batches:
        places = []
        for at in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
            now, seen = at, seen + 1 if at == now else 1
            places.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "k"])


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no from 1, value, file_name and parsed (a variant, null if the line is no JSON) of all lines but blank ones.

    A line may be JSON, or fields parted by tabs of which the last is; file_name is then the first. Files are read by
    blocks; a line's number is that in its block and the lines of the blocks before.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.rtrim("value", F.lit("\r")).alias("value"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.mapInArrow(_numbered, "path string, block bigint, value string, k bigint").join(blocks, ["path", "block"])
    some = numbered.where(F.regexp_replace("value", r"\s+", "") != "").select("path", (F.col("before") + F.col("k")).alias("line_no"), "value")
    whole, fields = F.try_parse_json("value"), F.split("value", "\t")
    return some.withColumn("file_name", F.when(whole.isNull() & (F.size(fields) > 1), fields[0])).withColumn("parsed", F.coalesce(whole, F.try_parse_json(F.element_at(fields, -1))))


def bad_lines(lines: DataFrame) -> DataFrame:
    """By path, lines and those that are no JSON."""
    return lines.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("parsed").isNull()).alias("n_bad"))


def last_decisions(lines: DataFrame, key: str = "$.capture_id") -> DataFrame:
    """The last line of each id, without comments."""
    some = lines.where(~F.trim("value").startswith("#")).withColumn("id", F.try_variant_get("parsed", key, "string")).where("id IS NOT NULL")
    return some.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("line_no"), F.desc("path")))).where("k = 1").drop("k")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """id and label of lines that begin with a whole number."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("int").alias("id"), F.get(parts, F.lit(1)).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def parse_box(v: Column) -> Column:
    """left, top, right, bottom of an element: named corners, or an array of four (with a size, if the corners would be
    out of order) or of eight; null if it has none."""
    return _corners(*_written(v))


def _written(v: Column) -> tuple[Column, Column]:
    """The named corners of an element, and its array."""
    named = [F.coalesce(*[_number(v, f"$.{n}") for n in names]) for names in (("left", "x0", "xmin"), ("top", "y0", "ymin"), ("right", "x1", "xmax"), ("bottom", "y1", "ymax"))]
    return F.array(*named), F.coalesce(*[F.try_variant_get(v, f"$.{n}", "array<double>") for n in ("box", "bbox", "quad")])


def _corners(whole: Column, arrays: Column) -> Column:
    four = [arrays[k] for k in range(4)]
    size = (four[2] < four[0]) | (four[3] < four[1])
    of_four = F.array(four[0], four[1], F.when(size, four[0] + four[2]).otherwise(four[2]), F.when(size, four[1] + four[3]).otherwise(four[3]))
    even, odd = F.filter(arrays, lambda x, k: k % 2 == 0), F.filter(arrays, lambda x, k: k % 2 == 1)
    of_eight = F.array(F.array_min(even), F.array_min(odd), F.array_max(even), F.array_max(odd))
    return F.when(~F.exists(whole, lambda x: x.isNull()), whole).when(F.size(arrays) == 4, of_four).when(F.size(arrays) == 8, of_eight)


def element_text(v: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in ("text", "value", "word", "transcription")])


def words_of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, word_idx, text and box from pages(doc_id, page), page a variant.

    The first of these that has any element: a list, words, tokens; else all elements of lines, textBlocks and blocks.
    Elements without text or a valid box go, and the others are numbered anew. A page is read once, in place: nothing is
    dealt out or sorted, and what an element says is looked up once.
    """
    listed = lambda path: F.try_variant_get("page", path, "array<variant>")
    none = F.array().cast("array<variant>")
    found = F.concat(*[F.coalesce(listed(f"$.{n}"), none) for n in ("lines", "textBlocks", "blocks")])
    for path in ("$.tokens", "$.words", "$"):
        found = F.when(F.size(listed(path)) > 0, listed(path)).otherwise(found)
    read = F.transform("items", lambda v: F.struct(F.trim(element_text(v)).alias("text"), *[c.alias(n) for n, c in zip(("whole", "array"), _written(v))]))
    made = F.transform("read", lambda e: F.struct(e["text"].alias("text"), _corners(e["whole"], e["array"]).alias("box")))
    fine = F.filter("made", lambda e: (e["text"] != "") & (e["box"][2] > e["box"][0]) & (e["box"][3] > e["box"][1]))
    held = pages.select("doc_id", found.alias("items")).select("doc_id", read.alias("read")).select("doc_id", made.alias("made"))
    return held.select("doc_id", F.posexplode(fine).alias("word_idx", "item")).select("doc_id", "word_idx", "item.text", "item.box")


def paired_files(spark: SparkSession, images: str, sheets: str) -> DataFrame:
    """stem, image and sheet: files that share a name without folder, suffix and known endings; the first of several."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), "(_ocr|_label|_labeled|_words)+$", "")
    files = lambda path, name: spark.read.format("binaryFile").load(path).select(stem.alias("stem"), F.col("path").alias(name)).groupBy("stem").agg(F.min(name).alias(name))
    return files(images, "image").join(files(sheets, "sheet"), "stem")
