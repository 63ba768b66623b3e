"""Benchmark decontamination: one Aho-Corasick automaton over the items' words, one scan of each text.

Words are normalised and spelled by their number in the items' own vocabulary, and the automaton reads that spelling. It
holds every CHUNK-th run of CHUNK words of an item, of which each window of WINDOW words holds one whole; where it meets
one in a text, the words on both sides tell how far text and item agree, and WINDOW words or more are hits. So the
automaton has as many words as the items, not WINDOW times as many. An item of fewer words is in it whole. Hits come as
word positions, and positions map back to code points.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import map_slices, materialise, texts_of

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Words between two runs of an item that the automaton holds, and of each of these.
CHUNK = (WINDOW + 1) // 2
#: Words of benchmark items in one automaton, some 0.3 KB each in a worker. A larger benchmark is read part by part,
#: with what is found written in between, so that no worker holds two.
AUTOMATON_WORDS = 2_000_000

#: A-Z to a-z; bytes that are not in words to spaces.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words of digits, letters and characters beyond ASCII."""
    return text.translate(_NORMAL).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code points (start, end) of each normal word, by its position."""
    data = text.encode()
    flags = np.frombuffer(b" " + data.translate(_NORMAL) + b" ", np.uint8) != 32
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
    return [(int(begins[a]), int(begins[b])) for a, b in zip(edges[::2], edges[1::2])]


def ordered(items: set[str | None]) -> list[str | None]:
    """Items in order, the one without an id last."""
    return sorted(items, key=lambda item: (item is None, item or ""))


class Matcher:
    """Windows of items, ready to find in texts.

    A word of the items is spelled in width letters, the k-th from an alphabet of its own, so that no node has over
    LETTERS children and no match can begin within a word; any other word is spelled in letters that no item has.
    """

    LETTERS = 32

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.numbers: dict[bytes, int] = {}
        by_text: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in normal_words(text))
            if ids:
                by_text.setdefault(ids, set()).add(item)
        self.texts, self.items = list(by_text), list(by_text.values())
        self.width = next(k for k in range(1, 99) if self.LETTERS**k >= len(self.numbers))
        spelling = [self._spell(n) for n in range(len(self.numbers))]
        self.spelled = dict(zip(self.numbers, spelling))
        self.other = chr(1) * self.width
        runs: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.texts):
            n = len(ids) if len(ids) < WINDOW else CHUNK
            for at in range(0, len(ids) - n + 1, n):
                runs.setdefault(ids[at : at + n], []).append((t, at))
        self.automaton = ahocorasick.Automaton()
        for run, places in runs.items():
            self.automaton.add_word("".join([spelling[n] for n in run]), (len(run), places))
        if runs:
            self.automaton.make_automaton()

    def _spell(self, number: int) -> str:
        letters = []
        for k in range(self.width):
            number, digit = divmod(number, self.LETTERS)
            letters.append(chr(2 + k * self.LETTERS + digit))
        return "".join(letters)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal intervals (first, end) of words inside occurrences of windows, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if not self.texts or not words:
            return spans, items
        numbers, reached = None, {}  # reached: by item and offset of a text, the first word behind what has been compared
        for last, (n, places) in self.automaton.iter("".join(map(self.spelled.get, words, repeat(self.other)))):
            end = (last + 1) // self.width
            if numbers is None:
                numbers = list(map(self.numbers.get, words, repeat(-1)))
            for t, at in places:
                ids, first = self.texts[t], end - n
                if len(ids) < WINDOW:
                    spans.append((first, end))
                    items |= self.items[t]
                elif reached.get((t, first - at), -1) < end:
                    low, high = first, end
                    while low > 0 and at > 0 and numbers[low - 1] == ids[at - 1]:
                        low, at = low - 1, at - 1
                    to = at + end - low
                    while high < len(numbers) and to < len(ids) and numbers[high] == ids[to]:
                        high, to = high + 1, to + 1
                    reached[t, low - at] = high
                    if high - low >= WINDOW:
                        spans.append((low, high))
                        items |= self.items[t]
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals of the union."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


#: The automaton that this worker built last, by the name of its items.
_built: dict[str, Matcher] = {}


def _matcher(name: str, shared) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(shared.value)
    return _built[name]


def _parts(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in parts of bounded size, in order of id; the driver holds one part at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    part, size = [], 0
    for row in items.orderBy("item", "text").toLocalIterator():
        text = row["text"].encode()
        n = len(normal_words(text))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((row["item"], text))
        size += n
    yield part


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: str | None = None, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """doc_id, n_words, spans (word intervals inside occurrences of benchmark windows) and items that occur.

    A row for each row of docs, repeated rows and null ids included; null texts have no words. A benchmark row with a
    null text is no item; an id on several rows is one item, and so are all rows that lack one: a null in items, last.
    Windows are WINDOW consecutive words, an item of fewer words is one window. keep carries the whole input row in a column of that name; other columns are ignored.
    """
    spark = docs.sparkSession
    row = [F.struct("*").alias("row")]
    now = docs.select(*row[: bool(keep)], F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)
    for k, part in enumerate(_parts(benchmark, automaton_words)):
        shared, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def scan(batch: pa.RecordBatch, shared=shared, name=name) -> dict:
            matcher = _matcher(name, shared)
            out = {name: batch.column(name) for name in batch.schema.names}
            words = [normal_words(t) for t in texts_of(batch.column("text"))]
            found = [matcher.find(w) for w in words]
            before = [[(s["first"], s["end"]) for s in spans] for spans in batch.column("spans").to_pylist()]
            out["n_words"] = [len(w) for w in words]
            out["spans"] = [[{"first": a, "end": b} for a, b in merged(old + spans)] for old, (spans, _) in zip(before, found)]
            out["items"] = [ordered({*old, *items}) for old, (_, items) in zip(batch.column("items").to_pylist(), found)]
            return out

        now = map_slices(materialise(now, "found") if k else now, scan, schema)
    out = now.drop("text")
    return out.withColumnRenamed("row", keep) if keep else out


def contaminated(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated to what find_contamination() returns.

    The item without an id counts as one of n_items; items_sha256, over the ids that there are, leaves it out.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["first"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    return contaminated(find_contamination(docs, benchmark)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
