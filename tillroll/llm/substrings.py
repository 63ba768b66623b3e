"""Substring dedup: every window of WINDOW words that occurs earlier too is removed, wherever it is.

All hashes are Rabin-Karp over words (llm.hashing); Spark counts them by sorting rows with the same hash together.

1. Each window has an anchor, the least hash of the ANCHOR-word windows inside it. Equal windows have equal anchors, so
   a window whose anchor no other place has is unique. Neighbouring windows with one anchor at one place form a run, about
   seven windows, with a hash of all its words. A task first settles what its own documents decide, over at most
   TOGETHER runs at once, and sends one row for an anchor: no key has more rows than that happens, whatever the corpus
   repeats. Among runs of equal anchor and words all but the first are removed. If all runs of an anchor have the same
   words, the first is settled by that too: equal windows hold their anchor at the same place. Else it is open.
2. Texts meet the runs of their documents. Windows of open runs are hashed and sorted in the same way, again one row a
   task for each, and all but the earliest of equal ones are removed. That settles runs that overlap in part.
3. A document's removed windows merge into maximal intervals of words.

Texts are moved once, by document: steps 2 and 3 read the same exchange. Equality is decided on the 62-bit hashes of
words, on 126 bits for runs and 94 for windows; unequal words or windows agree there with a chance of about 2**-55 or
less for each pair compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import SLICE_BYTES, SPACES, map_slices, slices, texts_of
from tillroll.llm.hashing import BASE, mix, spans_hash, word_hashes

WINDOW, ANCHOR = 20, 8
#: Runs, or windows of open runs, that a task holds and settles at once; some 100 bytes each.
TOGETHER = 1 << 20
#: Rows of one Arrow batch that goes back to Spark.
_ROWS = 1 << 16

#: What a run is, in the three low bits of its row; above them 30 bits for its windows and 31 for its first word.
ONCE, MARK, OPEN, REMOVED, SAME = range(5)


def packed(place: np.ndarray, n: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return place << 33 | n << 3 | kind


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, kind."""
    return run >> 33, run >> 3 & (1 << 30) - 1, run & 7


def text_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of a text, in order."""
    out, at = [], 0
    while at < len(data):  # in pieces that end at white space
        to = min(len(data), at + SLICE_BYTES)
        while to < len(data) and data[to] not in SPACES:
            to += 1
        out.append(word_hashes(np.frombuffer(data, np.uint8, to - at, at))[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts one after another, and the number of words of each."""
    size = sum(map(len, texts)) + len(texts)
    if size > 2 * SLICE_BYTES:
        each = [text_hashes(t) for t in texts]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
    hashes, start = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(start, ends, "left"), prepend=0)


def windows(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of WINDOW words within one document: its document, its first word there, its anchor (the least
    hash of ANCHOR words in it, the last of equal ones) and where that is."""
    n = len(hashes) - WINDOW + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.astype(np.uint64), empty
    at = np.arange(len(hashes) - ANCHOR + 1)
    least = mix(spans_hash(hashes, at, at + ANCHOR))
    width, reach = WINDOW - ANCHOR + 1, 1  # least of the next reach values and its place, by doubling
    while reach < width:
        by = min(reach, width - reach)
        right = least[by:] <= least[:-by]
        least, at = np.where(right, least[by:], least[:-by]), np.where(right, at[by:], at[:-by])
        reach += by
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(hashes)) - first[doc]
    whole = place[:n] + WINDOW <= counts[doc[:n]]
    return doc[:n][whole], place[:n][whole], least[whole], at[whole]


def runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor at one place: document, first window, number of windows, anchor, and hash of all words."""
    doc, place, anchor, at = windows(hashes, counts)
    if not len(doc):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]))
    n = np.diff(np.append(new, len(doc)))
    doc, place, anchor = doc[new], place[new], anchor[new]
    start = np.concatenate([[0], np.cumsum(counts)])[doc] + place
    content = mix(spans_hash(hashes, start, start + n + WINDOW - 1) + n.astype(np.uint64))
    return doc, place, n, anchor, content


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before in any of the columns."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if len(columns[0]) else np.zeros(0, bool)


def _leads(new: np.ndarray) -> np.ndarray:
    """For each row the last one so far that is new."""
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def _key(hashes: np.ndarray, kind: int) -> np.ndarray:
    """A hash with its two low bits for the kind of row, so that rows of different kinds never meet."""
    return (hashes & ~np.uint64(3) | np.uint64(kind)).view(np.int64)


def _spread(doc: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
    return _key(mix(doc.astype(np.uint64) * np.uint64(BASE) + place.astype(np.uint64)), kind)


def intervals(id: np.ndarray, tie: np.ndarray, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same windows as maximal intervals of each document: id, tie, place, n."""
    order = np.lexsort((place, tie, id))
    id, tie, place, end = id[order], tie[order], place[order], (place + n)[order]
    if not len(id):
        return id, tie, place, end
    document = np.cumsum(_changes(id, tie)).astype(np.int64) << 32  # ends of one document stay below those of the next
    reach = np.maximum.accumulate(document + end)
    new = np.concatenate([[True], document[1:] + place[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(id) - 1)
    return id[new], tie[new], place[new], (reach - document)[last] - place[new]


_RUN_ROW = ("key", "content", "id", "tie", "run")


def _settle_task(id: np.ndarray, tie: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> list[np.ndarray]:
    """Rows of step 1 for runs of some documents. Key: the anchor for ONCE (met once here), SAME (met with the same words
    each time, at the first of them) and MARK (met with different words); anchor and words for OPEN, the first of each of
    these; something that spreads for REMOVED, as the words are here earlier."""
    order = np.argsort(anchor, kind="stable")
    twin = anchor[order][1:] == anchor[order][:-1]
    many = np.zeros(len(order), bool)
    many[1:] |= twin
    many[:-1] |= twin
    once, some = order[~many], order[many]
    some = some[np.lexsort((place[some], tie[doc[some]], id[doc[some]], content[some], anchor[some]))]
    of, at, a, c = doc[some], place[some], anchor[some], content[some]
    group, new = np.cumsum(_changes(a)) - 1, _changes(a, c)
    mixed = np.bincount(group, new)[group] > 1 if len(group) else np.zeros(0, bool)
    # Rows of one document (same id and tie, a repeated row) at one place are one occurrence, never earlier than itself.
    lead = _leads(new)
    gone = ~new & ((at != at[lead]) | (id[of] != id[of[lead]]) | (tie[of] != tie[of[lead]]))
    same, open_ = new & ~mixed, new & mixed
    marks = a[_changes(a) & mixed]
    zero = np.zeros(len(marks), np.int64)
    gone_id, gone_tie, gone_at, gone_n = intervals(id[of[gone]], tie[of[gone]], at[gone], n[some[gone]])
    parts = [
        (_key(anchor[once], 0), content[once].view(np.int64), id[doc[once]], tie[doc[once]], packed(place[once], n[once], ONCE)),
        (_key(a[same], 0), c[same].view(np.int64), id[of[same]], tie[of[same]], packed(at[same], n[some[same]], SAME)),
        (_key(marks, 0), zero, zero, zero, zero + MARK),
        (_key(mix(a[open_] + mix(c[open_])), 1), c[open_].view(np.int64), id[of[open_]], tie[of[open_]], packed(at[open_], n[some[open_]], OPEN)),
        (_spread(gone_id, gone_at, 2), np.zeros(len(gone_id), np.int64), gone_id, gone_tie, packed(gone_at, gone_n, REMOVED)),
    ]
    return [np.concatenate(column) for column in zip(*parts)]


def _settle_all(key: np.ndarray, content: np.ndarray, id: np.ndarray, tie: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Rows of whole keys, sorted, to (id, tie, run) of runs that are removed or still open."""
    place, n, kind = unpacked(run)
    mark, group, new = kind == MARK, np.cumsum(_changes(key)) - 1, _changes(key, content, kind == MARK)
    mixed = (np.bincount(group, mark) + (np.bincount(group, new & ~mark) > 1) > 0)[group]
    lead = _leads(new)
    later = ~new & ((place != place[lead]) | (id != id[lead]) | (tie != tie[lead])) & ~mark
    removed = (kind == REMOVED) | later
    open_ = ~removed & new & ~mark & ((kind == OPEN) | mixed)
    keep = removed | open_
    return [id[keep], tie[keep], packed(place, n, np.where(removed, REMOVED, OPEN))[keep]]


def _settle_windows(key: np.ndarray, check: np.ndarray, id: np.ndarray, tie: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Rows of whole keys, sorted, to (id, tie, run) of windows that are removed."""
    new = _changes(key, check)
    lead = _leads(new)
    removed = (key & 3 == 2) | ~new & ((run != run[lead]) | (id != id[lead]) | (tie != tie[lead]))
    return [id[removed], tie[removed], run[removed]]


def _batches(columns: list[np.ndarray], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _ROWS]) for c in columns], list(names))


def _sorted_keys(df: DataFrame, settle: Callable[..., list[np.ndarray]]) -> DataFrame:
    """settle() over all rows of df, those with one key together and sorted by all columns; a key has few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last key so far
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            cut = int(np.searchsorted(columns[0], columns[0][-1], "left")) if len(columns[0]) else 0
            if held and cut == 0 and len(columns[0]) and columns[0][0] != held[-1][0][-1]:
                yield from _batches(settle(*map(np.concatenate, zip(*held))), ("id", "tie", "run"))
                held = []
            elif cut:
                whole = [np.concatenate(c) for c in zip(*held, [c[:cut] for c in columns])]
                held = []
                yield from _batches(settle(*whole), ("id", "tie", "run"))
            held.append([c[cut:] for c in columns])
        if held:
            yield from _batches(settle(*map(np.concatenate, zip(*held))), ("id", "tie", "run"))

    return df.repartition("key").sortWithinPartitions(*df.columns).mapInArrow(run, "id bigint, tie bigint, run bigint")


def _in_task(rows_of: Callable[[pa.RecordBatch], list[np.ndarray] | None], settle: Callable[[list[list[np.ndarray]]], list[np.ndarray]], together: int) -> Callable:
    """settle() over what rows_of() makes of slices, whenever a task holds so many rows, and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, batch.column("text")):
                made = rows_of(part)
                if made is not None:
                    held.append(made)
                    size += len(made[-1])
                if size >= together:
                    yield from _batches(settle(held), _RUN_ROW)
                    held, size = [], 0
        if held:
            yield from _batches(settle(held), _RUN_ROW)

    return run


def _part_runs(part: pa.RecordBatch) -> list[np.ndarray]:
    """id and tie of some documents, and their runs."""
    return [part.column("id").to_numpy(), part.column("tie").to_numpy(), *runs(*document_words(texts_of(part.column("text"))))]


def _settle_runs(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    return _settle_task(*_joined(held))


def _joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns of several slices as one, documents numbered on."""
    before = np.cumsum([0, *(len(h[0]) for h in held)])
    columns = list(zip(*held))
    columns[2] = [doc + at for doc, at in zip(columns[2], before)]
    return [np.concatenate(c) for c in columns]


def _places(run: np.ndarray) -> np.ndarray:
    """The first word of every window of some runs."""
    place, n, _ = unpacked(run)
    return np.repeat(place, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _open_windows(part: pa.RecordBatch) -> list[np.ndarray] | None:
    """Key, check, id, tie and first word of every window of the open runs of some documents."""
    found = [np.asarray(r.values.to_numpy() if r.is_valid else (), np.int64) for r in part.column("runs")]
    open_ = [r[r & 7 == OPEN] for r in found]
    some = [k for k, r in enumerate(open_) if len(r)]
    if not some:
        return None
    part = part.take(pa.array(some))
    hashes, counts = document_words(texts_of(part.column("text")))
    place = [_places(open_[k]) for k in some]
    of = np.repeat(np.arange(len(some)), [len(x) for x in place])
    place = np.concatenate(place)
    at = (np.cumsum(counts) - counts)[of] + place
    key = _key(mix(spans_hash(hashes, at, at + WINDOW)), 0)
    check = (spans_hash(mix(hashes + np.uint64(BASE)), at, at + WINDOW) >> np.uint64(32)).astype(np.int64)
    return [key, check, part.column("id").to_numpy()[of], part.column("tie").to_numpy()[of], place]


def _first_windows(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows of step 2: windows of open runs, the first of equal ones here, and as removed the others."""
    key, check, id, tie, place = map(np.concatenate, zip(*held))
    order = np.lexsort((place, tie, id, check, key))
    key, check, id, tie, place = (c[order] for c in (key, check, id, tie, place))
    new = _changes(key, check)
    lead = _leads(new)
    gone = ~new & ((place != place[lead]) | (id != id[lead]) | (tie != tie[lead]))
    gone_id, gone_tie, gone_at, gone_n = intervals(id[gone], tie[gone], place[gone], np.ones(int(gone.sum()), np.int64))
    first = (key[new], check[new], id[new], tie[new], packed(place[new], np.ones(int(new.sum()), np.int64), REMOVED))
    rest = (_spread(gone_id, gone_at, 2), np.zeros(len(gone_id), np.int64), gone_id, gone_tie, packed(gone_at, gone_n, REMOVED))
    return [np.concatenate(c) for c in zip(first, rest)]


def _by_document(found: DataFrame, name: str, by: list[str]) -> DataFrame:
    return found.repartition(*by).groupBy(*by).agg(F.collect_list("run").alias(name))


def _kept(text: str | None, *found: pa.Scalar) -> tuple[int, int, str, str]:
    """Words, removed words, and digest and text of those kept, for the removed runs found."""
    words = (text or "").encode().split()
    run = np.concatenate([np.asarray(f.values.to_numpy() if f.is_valid else (), np.int64) for f in found])
    place, n, kind = unpacked(run)
    place, n = place[kind == REMOVED], n[kind == REMOVED]
    removed = 0
    if len(place):
        edge = np.bincount(place, minlength=len(words) + 1) - np.bincount(place + n + WINDOW - 1, minlength=len(words) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = int(gone.sum())
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    kept = b" ".join(words)
    return len(words) + removed, removed, hashlib.sha256(kept).hexdigest(), kept.decode()


def deduplicate(docs: DataFrame, with_text: bool = True, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept, the words that stay, joined by one space.

    A row for each row of docs. Documents come in order of doc_id, a null one with the least number there is, then by a
    hash of the text; rows that repeat both are one document and share its result. Null texts have no words. Other
    columns are ignored. An empty table gives no rows.
    """
    id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    repeated = not docs.select(id.alias("id")).groupBy("id").count().where("count > 1").isEmpty()  # reads no texts
    text = F.col("text").cast("string")
    tie: Column = F.xxhash64(text, F.col("doc_id").isNull()) if repeated else F.lit(0).cast("bigint")
    keyed = docs.select(id.alias("id"), tie.alias("tie"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    schema = ", ".join(f"{c} bigint" for c in _RUN_ROW)
    rows = keyed.select("id", "tie", "text").mapInArrow(_in_task(_part_runs, _settle_runs, together), schema)
    by = ["id", "tie"] if repeated else ["id"]
    # The whole of met goes into both branches, so that they read the same exchange of texts.
    met = keyed.join(_by_document(_sorted_keys(rows, _settle_all), "runs", by), by, "left")
    opened = met.mapInArrow(_in_task(_open_windows, _first_windows, together), schema)
    last = met.join(_by_document(_sorted_keys(opened, _settle_windows), "more", by), by, "left")

    def finish(part: pa.RecordBatch) -> dict:
        made = [_kept(t, *found) for t, *found in zip(part.column("text").to_pylist(), part.column("runs"), part.column("more"))]
        return {"doc_id": part.column("doc_id")} | {name: [m[k] for m in made] for k, name in enumerate(columns)}

    columns = ("n_words", "n_removed", "kept_sha256", "kept")[: 3 + with_text]
    return map_slices(last, finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * with_text)


def substring_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    return deduplicate(docs, with_text=False)
