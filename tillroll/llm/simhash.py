"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at RADIUS or fewer differing bits. Each bit position gets a nonzero vector of
GF(2)^(RADIUS+1); table v keeps the bits whose vector has an odd inner product with v. For any RADIUS positions some
nonzero v is orthogonal to all their vectors, so two fingerprints that differ there agree on all that table v keeps:
every pair within the radius meets in some table, none is missed.

Equal fingerprints are one item from the start. A bucket with more than BUCKET fingerprints is dealt out again by a
second covering code on the bits that its table leaves open; what is then still open are at most 12 bits, so no bucket
holds more than 4096 fingerprints, whatever the size of the corpus. A bucket gives a spanning forest, not pairs.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import discard, map_slices, materialise, texts_of

BITS, RADIUS, SEED = 64, 2, 42
#: Fingerprints of a bucket that one call links; larger ones are dealt out by the second code.
BUCKET = 4096

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each text: words lower-cased in ASCII, 3-word shingles with repeats, XXH64 with seed 42.

    A bit is set if it is in over half of the hashes. Fewer than three words are one shingle; no words give 0.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = counts[i] = min(len(words), max(1, len(words) - 2))
        if n:
            shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) > 2 else [b" ".join(words)]
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))
    if not hashes:
        return np.zeros(len(texts), np.uint64)
    octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
    row = np.repeat(np.arange(len(texts)), counts) << 8
    bits = np.zeros((len(texts), BITS), np.uint8)
    for k in range(8):
        of_byte = np.bincount(row + octets[:, k], minlength=len(texts) << 8).reshape(-1, 256)
        bits[:, 8 * k : 8 * k + 8] = 2 * (of_byte @ _BYTE_BITS) > counts[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Bit masks over these positions; any radius of them are missing together from one mask at least."""
    full = (1 << (radius + 1)) - 1
    vector = {p: 1 + k % full for k, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, full + 1)]


MASKS = covering_masks(list(range(BITS)))
#: For each table, the masks of the second code: the table's own bits and some of those it leaves open.
FINER = [[m | more for more in covering_masks([p for p in range(BITS) if not m >> p & 1])] for m in MASKS]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(df: DataFrame, masks: list[list[int]]) -> DataFrame:
    """A row for each mask: t, the table's number, and key, what the mask keeps of fp."""
    return df.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key")) for t, m in enumerate(masks)])).alias("x")).select("fp", "x.t", "x.key")


def spanning(fps: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Pairs (fingerprint, first fingerprint of its component) within one bucket."""
    left, a, b = fps.astype(np.uint64), [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            near = np.bitwise_count(left ^ frontier.pop()) <= radius
            if near.any():
                frontier.extend(found := left[near])
                left = left[~near]
                a.extend(found.view(np.int64).tolist())
                b.extend([int(root.view(np.int64))] * len(found))
    return a, b


def _link(batches):
    for batch in batches:
        for fps in batch.column("fps"):
            a, b = spanning(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that span the graph of distinct fingerprints fp within RADIUS of each other."""
    keyed = _keyed(fps, MASKS)
    counted = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counted, ["t", "key"])
    small = met.where(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    finer = F.element_at(F.array(*[F.array(*[F.lit(_long(m)) for m in row]) for row in FINER]), F.col("t") + 1)
    large = met.where(F.col("n") > bucket).select("fp", "t", F.posexplode(finer).alias("s", "mask")).groupBy("t", "s", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).agg(F.collect_list("fp").alias("fps")).select("fps")
    return small.unionByName(large.where(F.size("fps") > 1)).mapInArrow(_link, "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, root) for each node of the undirected edges (u, v): alternating large-star and small-star rounds.

    Every round is written to the shared folder and the round before it deleted; hub nodes are plain join keys, whose
    partitions adaptive execution splits. Only a count and a checksum come to the driver.
    """
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now u > v holds everywhere: the small star ties the lesser neighbours of u, and u, to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialise(small.distinct(), "edges")
        discard(now)
        before, now, seen = seen, after, mark(after)
        if seen == before:
            return now.select("u", F.col("v").alias("root"))


def _fingerprinted(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp and further bigint columns of each row, on the shared folder."""

    def run(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column("doc_id"), "fp": fingerprints(texts_of(part.column("text"))).view(np.int64)} | {c: part.column(c) for c in more}

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return materialise(map_slices(wanted, run, ", ".join(f"{c} bigint" for c in ("doc_id", "fp", *more))), "fingerprints")


def _rooted(fps: DataFrame, bucket: int) -> DataFrame:
    """Adds root, a fingerprint that stands for the component, to a table of distinct fingerprints fp."""
    roots = connected_components(links(fps.select("fp"), bucket))
    return fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of all rows reachable over links.

    A row for each row of docs. Null and empty texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id are separate items with that id; a null doc_id stays null and counts for no component's id, so a component of
    only such rows has a null id. Other columns are ignored. An empty table gives no rows.
    """
    rows = _fingerprinted(docs)
    named = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), bucket)
    of_root = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_fp = named.join(of_root, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of the column row, a struct of all columns of docs; a null counts with its place."""
    values = [F.col("row").getField(c) for c in docs.columns]
    hashed = [F.to_json(F.struct(v)) if "map<" in t else v for v, (_, t) in zip(values, docs.dtypes)]
    return [F.xxhash64(F.lit(k), *[v.isNull() for v in values], *hashed).alias(f"h{k}") for k in (1, 2)]


def survivors(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """One row of each component of near-duplicates: that with the least doc_id, of equal ids the least row hash.

    A null doc_id comes after all others. Rows are told apart by 128 bits of hashes over all their columns, so one with a
    repeated or null id stays only if it leads its own component. Minima are by fingerprint, then by component.
    """
    held = docs.select(F.struct("*").alias("row")).select("row", *_row_hashes(docs))
    rows = _fingerprinted(held.select("row.doc_id", "row.text", "h1", "h2"), "h1", "h2")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = _rooted(rows.groupBy("fp").agg(F.min(order).alias("first")), bucket).groupBy("root").agg(F.min("first").alias("first"))
    kept = held.join(first.select("first.h1", "first.h2"), ["h1", "h2"], "left_semi")
    repeated = not rows.groupBy("h1", "h2").count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["h1", "h2"]) if repeated else kept).select("row.*")
