"""Token ids as binary shards: canonical Huffman codes from global counts, decoded block by block.

A shard is one file. All numbers are little-endian:

    magic "TRSHARD1", then eight 64-bit numbers: partition, shard number in it, documents, ids, blocks, bytes of bits,
    bytes of the packed code lengths, size of the vocabulary
    code lengths, a byte for each id, deflated
    doc_id of each document, 64 bits; a byte for each, 0 where the id is null; ids of each document, 64 bits
    bit offset of each block in the bit streams, 64 bits
    the documents' bit streams, each from a byte of its own; one line feed

Spark's text writer makes the files from a string column that holds these bytes, which gives them its commit protocol
on any file system; its line end is the format's last byte. Shards are read as binary files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.llm import huffman
from tillroll.llm._common import discard, map_slices, materialise, shared_path, slices
from tillroll.llm.hashing import segment_hashes

MAGIC = b"TRSHARD1"
_HEAD = struct.Struct("<8s8Q")
#: Id that ends each document.
END_ID = 0
#: Bytes of bit streams after which a shard is closed; one longer document is a shard of its own.
SHARD_BYTES = 8 << 20
#: Segments whose ids a worker remembers before it starts afresh, some 40 bytes each.
REMEMBERED = 2_000_000
#: Bytes of a text whose segments are looked up at once.
PIECE = 1 << 21

_BREAKS = re.compile(r"\s\s|[^\S \n]")
#: Letters of two bytes at most, which every version of Unicode calls so.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTER, _MARK = (np.array([re.match(pattern, chr(b), re.ASCII) is not None and b < 128 for b in range(256)]) for pattern in ("[A-Za-z]", r"[^A-Za-z0-9\s]"))
#: Told apart from a segment without a space before it.
_SPACED = np.uint64(0x5BD1E9955BD1E995)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, as bytes of numbers of a type code, by a byte-level BPE file of the tokenizers library.

    That library's byte-level pre-tokenizer always begins a piece at a single space or line feed between two other
    characters, and after the last letter of a word; and pieces are encoded alone. So a text whose white space is all of
    that kind is the concatenation of the ids of its segments, cut at these places, and segments are remembered by
    two independent hashes. Any other text goes to the library whole, and so do all if a file has another pre-tokenizer.
    New segments go to the library many at a time, and part again where a token begins with a space.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        #: Type code of the narrowest numbers that hold the ids.
        self.code = "H" if self.size <= 1 << 16 else "I"
        form = json.loads(self.tokenizer.to_str())
        cut = form["pre_tokenizer"] or {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        written = lambda text: level.pre_tokenize_str(text)[0][0]  # noqa: E731  as the vocabulary writes its bytes
        self.space, self.feed = written(" "), written("\n")
        self.by_segments = cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and form["normalizer"] is None and form["model"]["type"] == "BPE" and not form["model"]["dropout"] and len(self.library(["\n"])[0]) == array(self.code).itemsize
        self.begins = np.zeros(self.size, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.begins[k] = token.startswith(self.space) or token == self.feed
        self.pieces = Tokenizer.from_file(path)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.writing = {k: written(chr(k)) for k in range(256) if _LETTERS.match(chr(k))}
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # executors run a worker on each core already
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        #: Sorted hashes of the segments, their second hashes and rows; by row, where its ids begin and how many; all ids.
        self.keys, self.checks, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.code)

    def library(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, tokenizer, texts: list[str], unspaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of texts that go as one, where each text's begin and how many; an unspaced one comes after a line feed."""
        ids = np.asarray(tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, self.code)
        cuts = np.flatnonzero(self.begins[ids])
        return (ids, cuts + unspaced, np.diff(cuts, append=len(ids)) - unspaced) if len(cuts) == len(texts) else None

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.code, count.sum()), np.cumsum(count) - count, count

    def learn(self, segments: list[str], spaced: np.ndarray) -> None:
        """Remember the ids of segments, as the next rows."""
        words = np.fromiter((_LETTERS.fullmatch(s) is not None for s in segments), bool, len(segments))
        first, count, held, size = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64), [self.ids], len(self.ids)
        for group, encode in (
            (np.flatnonzero(words), lambda some: self._together(self.pieces, [(f" {self.space}" if spaced[k] else f" {self.feed} ") + segments[k].translate(self.writing) for k in some], ~spaced[some])),
            (np.flatnonzero(~words & spaced), lambda some: self._together(self.tokenizer, texts := [" " + segments[k] for k in some], np.zeros(len(some), bool)) or self._each(texts)),
            (np.flatnonzero(~words & ~spaced), lambda some: self._each([segments[k] for k in some])),
        ):
            if len(group):
                ids, first[group], count[group] = encode(group)
                first[group] += size
                size += len(ids)
                held.append(ids)
        self.ids, self.first, self.count = np.concatenate(held), np.append(self.first, first), np.append(self.count, count)

    def plain(self, text: str) -> bool:
        if not self.by_segments or not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in self.special):
            return False
        if text.replace("\n", "").isprintable():  # no white space but spaces and line feeds
            return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text)
        return not _BREAKS.search(text)

    def _segments(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments begin and end: words, cut after the last letter before a mark, and line feeds."""
        gap, line = raw == 32, raw == 10
        letter = _LETTER[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        begins = ~gap
        begins[1:] &= gap[:-1] | line[:-1] | line[1:] | _MARK[raw[1:]] & letter[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw))
        return start, end - gap[end - 1]

    def _lookup(self, pieces: list[bytes], spaced: list[bool]) -> list[np.ndarray] | None:
        """The ids of plain pieces, some of which have a space before them; None if two segments had the same hash."""
        if len(self.keys) > REMEMBERED:
            self.forget()
        data = b" ".join(pieces)
        raw = np.frombuffer(data, np.uint8)
        start, end = self._segments(raw)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        whose = np.searchsorted(start, np.cumsum(size) - size)  # the first segment of each piece
        after = raw[start - 1] == 32
        after[whose] = spaced
        key, check = segment_hashes(raw, start, end)
        key = np.where(after, key ^ _SPACED, key)
        key, which, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, key)
        known = self.keys[np.minimum(place, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        if (check != check[which][back]).any() or (self.checks[place[known]] != check[which[known]]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            at = which[new]
            rows = len(self.count) + np.arange(len(new))
            self.learn([data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist())], after[at])
            self.keys, self.checks, self.rows = (np.insert(have, place[new], more) for have, more in ((self.keys, key[new]), (self.checks, check[at]), (self.rows, rows)))
            place = np.searchsorted(self.keys, key)
        row = self.rows[place][back]
        count = self.count[row]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[row] - ends + count, count) + np.arange(ends[-1])]
        return np.split(ids, (ends - count)[whose[1:]])

    def _pieces(self, text: str) -> list[bytes]:
        """A plain text cut before a space now and then, without that space."""
        data, out, at = text.encode(), [], 0
        while at < len(data):
            to = data.find(b" ", at + PIECE)
            to = len(data) if to < 0 else to
            out.append(data[at:to])
            at = to + 1
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.plain(t)]
        short = [k for k in plain if len(texts[k]) <= PIECE]
        for group in ([short] if short else []) + [[k] for k in plain if len(texts[k]) > PIECE]:
            if group[0] in short[:1]:
                made = self._lookup([texts[k].encode() for k in group], [False] * len(group))
            else:
                parts = [self._lookup([piece], [k > 0]) for k, piece in enumerate(self._pieces(texts[group[0]]))]
                made = None if None in parts else [np.concatenate([p[0] for p in parts])]
            for k, ids in zip(group, made or ()):
                out[k] = ids.tobytes()
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(rest, self.library([texts[k] for k in rest])):
            out[k] = ids
        return out


def encode_ids(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of every whole text with the end id, as bytes of numbers of the encoder's type code."""

    def encode(part: pa.RecordBatch) -> dict:
        encoder = Encoder.of(path)
        end = array(encoder.code, [end_id]).tobytes()
        return {"doc_id": part.column("doc_id"), "ids": [ids + end for ids in encoder([t or "" for t in part.column("text").to_pylist()])]}

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), encode, "doc_id bigint, ids binary")


def _unpacked(part: pa.RecordBatch, code: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the slice's documents, and how many each has."""
    made = part.column("ids").to_pylist()
    return np.frombuffer(b"".join(made), code), np.fromiter(map(len, made), np.int64, len(made)) // array(code).itemsize


def id_counts(ids: DataFrame, code: str) -> np.ndarray:
    """How often each id occurs in encode_ids() of all documents; the driver gets a row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for part in slices(batch, batch.column("ids")):
                found = np.bincount(_unpacked(part, code)[0], minlength=len(total))
                found[: len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] + 1 for r in rows], default=1), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def range_cuts(ids: DataFrame, parts: int) -> np.ndarray:
    """Ascending ids that part the rows into so many ranges of about as many rows each; one that fills whole ranges is
    there more than once. A null id counts as the least number."""
    if parts < 2:
        return np.zeros(0, np.int64)
    least = F.coalesce("doc_id", F.lit(-(1 << 63)))
    found = ids.agg(F.percentile_approx(least, [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    return np.array(sorted(found or []), np.int64)


def range_of(ids: np.ndarray, cuts: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The range of each id; an id that fills several ranges is dealt out among them by spread."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    return low + spread % (high - low + 1)


def _streams(ids: DataFrame, code: str, book: tuple[np.ndarray, np.ndarray], cuts: np.ndarray) -> DataFrame:
    shared = ids.sparkSession.sparkContext.broadcast((*book, cuts))

    def encode(part: pa.RecordBatch) -> dict:
        codes, lengths, cuts = shared.value
        ids, sizes = _unpacked(part, code)
        stream, starts, offsets, blocks = huffman.encode(ids, sizes, codes, lengths)
        at = np.concatenate([[0], np.cumsum(blocks)])
        n = len(sizes)
        bits = [stream[starts[i] : starts[i + 1]] for i in range(n)]
        # Texts without words are all alike, so they may be dealt out by their place; others go by what they hold.
        spread = np.where(sizes == 1, np.arange(n), np.fromiter(map(zlib.crc32, bits), np.int64, n))
        known = pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy()
        return {
            "doc_id": part.column("doc_id"),
            "n_tokens": sizes,
            "bits": bits,
            "offsets": [offsets[at[i] : at[i + 1]].astype("<i8").tobytes() for i in range(n)],
            "pid": range_of(known, cuts, spread).astype(np.int32),
        }

    return map_slices(ids, encode, "doc_id bigint, n_tokens bigint, bits binary, offsets binary, pid int", text="ids")


def _shard(pid: int, number: int, rows: list[tuple], lengths: np.ndarray) -> bytes:
    ids, sizes, bits, offsets = zip(*rows)
    packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 9)
    streams = b"".join(bits)
    starts = np.cumsum([0, *map(len, bits[:-1])])
    blocks = b"".join((np.frombuffer(o, "<i8") + 8 * at).astype("<i8").tobytes() for o, at in zip(offsets, starts))
    head = _HEAD.pack(MAGIC, pid, number, len(rows), sum(sizes), len(blocks) // 8, len(streams), len(packed), len(lengths))
    return b"".join([head, packed, np.asarray([i or 0 for i in ids], "<i8").tobytes(), bytes(i is not None for i in ids), np.asarray(sizes, "<i8").tobytes(), blocks, streams])


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the shards of docs to a folder, in ascending order of doc_id.

    A null id comes first, a null text has the end id alone; rows that repeat an id follow each other. Other columns are
    ignored; an empty table writes no shard. Documents are dealt out by ranges of ids that hold about as many rows each;
    an id that fills more than one range is dealt out among those. Texts are encoded once: their ids are written to the
    shared folder for the counts and then the codes, and deleted at the end.
    """
    spark, path = docs.sparkSession, path or vocabulary_path()
    encoded, code = materialise(encode_ids(docs, path, end_id), "ids"), Encoder.of(path).code
    lengths = huffman.code_lengths(id_counts(encoded, code))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    streams = _streams(encoded, code, (huffman.canonical(lengths), lengths), range_cuts(encoded.select("doc_id"), parts))
    dealt = streams.repartitionById(parts, F.col("pid")).sortWithinPartitions("pid", F.asc_nulls_first("doc_id"), "n_tokens", "bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, number, at = [], 0, 0, None
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([_shard(at, number, rows, lengths)], pa.binary())], ["shard"])
        for batch in batches:
            for pid, *row in zip(*(batch.column(c).to_pylist() for c in ("pid", "doc_id", "n_tokens", "bits", "offsets"))):
                if rows and (size + len(row[2]) > shard_bytes or pid != at):
                    yield closed()
                    rows, size, number = [], 0, number + 1 if pid == at else 0
                at = pid
                rows.append(row)
                size += len(row[2])
        if rows:
            yield closed()

    dealt.mapInArrow(pack, "shard binary").select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)
    discard(encoded)


def _read(shard: bytes) -> tuple[tuple, np.ndarray, list, np.ndarray]:
    """Header, ids of all documents one after another, doc_ids, and ids of each document."""
    head = _HEAD.unpack_from(shard)
    if head[0] != MAGIC:
        raise ValueError("not a shard")
    _, pid, number, n_docs, n_ids, n_blocks, n_bytes, n_packed, n_vocabulary = head
    at = _HEAD.size
    lengths = np.frombuffer(zlib.decompress(shard[at : at + n_packed]), np.uint8)
    at += n_packed
    doc_ids = np.frombuffer(shard, "<i8", n_docs, at)
    known = shard[at + 8 * n_docs : at + 9 * n_docs]
    at += 9 * n_docs
    sizes = np.frombuffer(shard, "<i8", n_docs, at)
    offsets = np.frombuffer(shard, "<i8", n_blocks, at + 8 * n_docs)
    at += 8 * n_docs + 8 * n_blocks
    blocks = (sizes + huffman.BLOCK - 1) // huffman.BLOCK
    last = np.cumsum(blocks) - 1
    count = np.full(n_blocks, huffman.BLOCK, np.int64)
    count[last] = sizes - huffman.BLOCK * (blocks - 1)
    ids = huffman.decode(shard[at : at + n_bytes], offsets, count, huffman.decode_table(lengths))
    if len(ids) != n_ids:
        raise ValueError("a shard is damaged")
    return (pid, number, n_ids), ids, [int(d) if k else None for d, k in zip(doc_ids, known)], sizes


def read_shards(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, the ids of every document.

    Shards decode independently. Their places follow from running sums over the shards of a partition, and over one row
    for each partition.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in chain.from_iterable(batch.column("content") for batch in batches):
            (pid, number, n_ids), ids, doc_ids, sizes = _read(shard.as_py())
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
            n = len(sizes)
            columns = [pa.array([pid] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["pid", "number", "doc_id", "place", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "pid bigint, number bigint, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    rows = materialise(files.mapInArrow(decode, schema), "decoded")
    shards = rows.groupBy("pid", "number").agg(F.sum("n_tokens").alias("n"))
    ranges = shards.groupBy("pid").agg(F.sum("n").alias("n"))  # a row for each partition that wrote
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = ranges.select("pid", before(Window.orderBy("pid")).alias("first"))
    bases = shards.withColumn("inside", before(Window.partitionBy("pid").orderBy("number"))).join(first, "pid").select("pid", "number", (F.col("first") + F.col("inside")).alias("base"))
    return rows.join(bases, ["pid", "number"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs as shards in the shared folder and read them back: doc_id, start, n_tokens and ids_crc32."""
    folder = shared_path(docs.sparkSession, "shards")
    write_shards(docs, folder, path)
    return read_shards(docs.sparkSession, folder, with_ids=False)
