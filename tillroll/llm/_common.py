"""What the operators of this subpackage share: shared storage, and bounded slices of Arrow batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text that is worked on at once in a Python worker; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

#: ASCII white space, as bytes.split() sees it.
SPACES = b" \t\n\r\x0b\f"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a temporary one if all
    run on this machine; on a cluster that is an error, as executors would write to disks that others do not see."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("tillroll.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tillroll-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("tillroll.shared.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/tillroll/{name}-{uuid.uuid4().hex}"
    target, system = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: its lineage ends there, on storage that outlives executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tillroll_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df."""
    remove(df.sparkSession, df._tillroll_path)


def remove(spark: SparkSession, path: str) -> None:
    target, system = _file_system(spark, path)
    system.delete(target, True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, b"" for null."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with at most so many bytes of text or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, text: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """fn makes the columns of the output from a bounded slice of df; it sees each row once and keeps nothing between slices."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(text), most):
                made = fn(part)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in zip(out, made.values(), strict=True)], schema=out)

    return df.mapInArrow(run, schema)
