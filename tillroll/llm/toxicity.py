"""Toxic passages as maximal scoring segments of token log-odds.

Features of a word are its beginnings, which catch inflected and compound forms, and the word itself. How often a feature
occurs in toxic and in other labelled documents has a Dirichlet prior: its mean is the rate of the next shorter
feature in that class times the share that the whole corpus gives the longer one in the shorter, its weight PRIOR
occurrences. So a word's log-odds are a sum of what each of its features adds, of either sign, and rare words stay with
what their beginnings say. Less a fixed cost that is a token's score. All maximal segments (Ruzzo and Tompa) of a text
are found in one linear scan. Extreme-value statistics (Karlin and Altschul) say how many segments of a score a clean
text of that length holds by chance; both constants come from the words and best segments of clean labelled texts. A
logistic curve over the best segment and the sum of significant ones gives the document's score. Statistics and
curve are fitted on documents that had no part in the log-odds that they are scored with: each fold by the others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import discard, map_slices, materialise, slices, texts_of
from tillroll.llm.decontaminate import _NORMAL
from tillroll.llm.hashing import BASE, BYTE, INVERSE, mix, powers
from tillroll.llm.labelled import held_out, training_sample

#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 20_000
#: Lengths in bytes of the beginnings that are features of longer words.
BEGINNINGS = (5, 6, 7, 8, 9)
#: Documents of the sample that a feature with a score must be in; one in fewer adds nothing to its beginnings.
LEAST_DOCS = 3
#: Weight of the prior of a feature's rate, in occurrences.
PRIOR = 1.0
#: Cost of a token: log-odds that a passage must have on average to be toxic. This and the least number of documents had the
#: least cross-fitted loss on labelled documents that may be learnt from.
COST = 1.5
#: Scores are multiples of this, so that clean words have a bounded number of them.
GRAIN = 1 / 256
#: Parts of the sample, each scored by log-odds of the others.
CROSS = 3
FOLDS, FOLD = 3, 1
THRESHOLD = 0.7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the features of each distinct normal word of some texts, its beginnings by length, then the word;
    which of them each word is; and the number of words of each text. A beginning as long as the word or longer is 0."""
    raw = np.frombuffer(b" ".join(texts).translate(_NORMAL) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(raw != 32, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers(BASE, len(raw)), out=sums[1:])
    inverse = powers(INVERSE, len(raw) + 1)
    counts = np.diff(np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]), "left"), prepend=0)
    whole, which, back = np.unique(mix((sums[end] - sums[start]) * inverse[start]), return_index=True, return_inverse=True)
    start, end = start[which], end[which]
    out = np.zeros((len(whole), len(BEGINNINGS) + 1), np.uint64)
    out[:, -1] = whole
    for k, n in enumerate(BEGINNINGS):
        long = end - start > n
        out[long, k] = mix((sums[start[long] + n] - sums[start[long]]) * inverse[start[long]] + np.uint64(n))
    return out, back, counts


def parents(of: np.ndarray) -> np.ndarray:
    """For each feature in rows of features() the one that it extends, 0 if none."""
    out = np.zeros_like(of)
    out[:, 1:-1] = of[:, :-2]
    out[:, -1] = _last(of[:, :-1])
    return out


def _last(beginnings: np.ndarray) -> np.ndarray:
    """The longest beginning of each row, 0 if none."""
    n = (beginnings != 0).sum(axis=1)
    return np.where(n > 0, beginnings[np.arange(len(n)), np.maximum(n - 1, 0)], np.uint64(0))


class Lookup:
    """Places of hashes in a sorted array; a bitmap settles most hashes that it lacks."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = min(24, max(16, len(known).bit_length() + 4))
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self._cell(known)] = True

    def _cell(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and their places."""
        maybe = np.flatnonzero(self.bitmap[self._cell(hashes)])
        if not len(self.known):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        right = self.known[at] == hashes[maybe]
        return maybe[right], at[right]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    Runs of positive scores, and of others, are taken in one step, by their sum.
    """
    found: list[list] = []  # [start, end, sum before, sum through, place below], candidates that no later run has joined yet
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edges = np.flatnonzero(np.diff(scores > 0, prepend=False, append=False))
    for a, b, low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), total[edges[::2]].tolist(), total[edges[1::2]].tolist()):
        new = [a, b, low, high]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new.append(j)  # the nearest candidate that begins lower; those between can't be joined from here on
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    """Sorted hashes of features and what each adds; the statistics of chance segments; the curve."""

    words: np.ndarray
    gains: np.ndarray
    rate: float = 1.0
    scale: float = 0.1
    curve: np.ndarray | None = None
    cost: float = COST

    def tokens(self, of: np.ndarray) -> np.ndarray:
        """The score of each word, from its row of features."""
        if not hasattr(self, "_lookup"):
            self._lookup = Lookup(self.words)
        which, at = self._lookup.find(of.ravel())
        return np.bincount(which // of.shape[1], self.gains[at], len(of)) - self.cost

    def scores(self, texts: list[bytes]) -> list[np.ndarray]:
        """The scores of the words of each text."""
        of, back, counts = features(texts)
        return np.split(self.tokens(of)[back], np.cumsum(counts)[:-1]) if texts else []

    def evidence(self, scores: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
        """(1, surprise of the best segment, of all significant ones, whether any), and segments with their surprise.

        The surprise is -ln of how many such segments chance gives in a text of this length; over 0 is significant.
        """
        least = np.log(self.scale * max(1, len(scores)))
        segments = [(a, b, self.rate * s - least) for a, b, s in maximal_segments(scores)]
        known = [s for s in segments if s[2] > 0]
        best = max((s[2] for s in segments), default=-least)
        return np.array([1.0, np.clip(best, -10, 30) / 10, np.log1p(sum(s[2] for s in known)), float(bool(known))]), known

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ (np.zeros(4) if self.curve is None else self.curve), -40, 40)))


def gains(parent: np.ndarray, level: np.ndarray, corpus: np.ndarray, size: int, counts: tuple[np.ndarray, np.ndarray], sizes: tuple[float, float]) -> np.ndarray:
    """What each feature adds to the log-odds of its words. parent: the place of the feature that it extends, -1 if none;
    corpus and size: occurrences in all documents, and words there; counts and sizes: the same of clean and toxic ones."""
    share = np.maximum(corpus, 1) / max(1, size)
    rates = [np.zeros(len(parent)), np.zeros(len(parent))]
    out = np.zeros(len(parent))
    for k in range(len(BEGINNINGS) + 1):
        at = np.flatnonzero(level == k)
        up = parent[at]
        part = share[at] / np.where(up < 0, 1.0, share[up])
        for rate, n, of, sign in zip(rates, counts, sizes, (-1, 1)):
            mean = np.where(up < 0, 1.0, rate[up]) * part
            moved = (n[at] + PRIOR) / (of * mean + PRIOR)
            rate[at] = mean * moved
            out[at] += sign * np.log(moved)
    return np.round(out / GRAIN) * GRAIN


def _rate(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(rate * score) = 1; the expected score is below zero."""
    if not len(scores) or scores.max() <= 0 or (share * scores).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    over = lambda x: (share * np.exp(np.minimum(x * scores, 500))).sum() > 1
    while not over(high):
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return high


def _scale(rate: float, sizes: np.ndarray, best: np.ndarray) -> float:
    """The likeliest K if the best segment of a text of n words is over x by chance with 1 - exp(-K n exp(-rate x))."""
    return len(sizes) / np.sum(sizes * np.exp(-rate * best))


def chance(models: Broadcast, sample: DataFrame) -> tuple[float, float]:
    """Rate and scale of chance segments, from the scores of words and the best segments of clean texts, each by the model
    that did not learn from it. The driver gets two numbers for each text, and a row for each score that words have."""

    def weigh(part: pa.RecordBatch) -> dict:
        out = []
        for text, cross in zip(texts_of(part.column("text")), part.column("cross").to_pylist()):
            scores = models.value[cross].scores([text])[0]
            values, n = np.unique(scores, return_counts=True)
            out.append((len(scores), max((s for *_, s in maximal_segments(scores)), default=0.0), [{"score": float(v), "n": int(c)} for v, c in zip(values, n)]))
        return {name: [x[k] for x in out] for k, name in enumerate(("n", "best", "scores"))}

    seen = materialise(map_slices(sample.where("label = 0"), weigh, "n bigint, best double, scores array<struct<score:double,n:bigint>>"), "chance")
    texts = np.array(sorted(map(tuple, seen.where("n > 0").select("n", "best").collect())), float).reshape(-1, 2)
    tally = np.array(sorted(map(tuple, seen.select(F.explode("scores").alias("s")).groupBy("s.score").agg(F.sum("s.n")).collect())), float).reshape(-1, 2)
    discard(seen)
    if not len(texts):
        return 1.0, 0.1
    rate = _rate(tally[:, 0], tally[:, 1] / tally[:, 1].sum())
    return rate, _scale(rate, texts[:, 0], texts[:, 1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 1e-2 * np.eye(x.shape[1])
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def _counted(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the features, and any word, occurs in all documents; a row for each feature reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        lookup = Lookup(shared.value)
        total = np.zeros(len(lookup.known) + 1, np.int64)
        for batch in batches:
            for part in slices(batch, batch.column("text")):
                of, back, _ = features(texts_of(part.column("text")))
                which, at = lookup.find(of.ravel())
                times = np.bincount(back, minlength=len(of))
                total[:-1] += np.bincount(at, times[which // of.shape[1]], len(lookup.known)).astype(np.int64)
                total[-1] += len(back)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["k", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def _sample_counts(sample: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The features of the sample in order of hash, as columns: word, parent (a place, -1 for none), level, and by part
    of the sample docs, clean and toxic; and the words of the sample by part and class."""

    def count(part: pa.RecordBatch) -> dict | None:
        of, back, n = features(texts_of(part.column("text")))
        doc = np.repeat(np.arange(len(n)), n)
        pair, times = np.unique(back.astype(np.int64) * len(n) + doc, return_counts=True)  # a word in a document
        word, doc = np.divmod(pair, len(n))
        of, up, level = of[word], parents(of)[word], np.broadcast_to(np.arange(of.shape[1]), (len(word), of.shape[1]))
        real = of != 0
        doc, times = (np.broadcast_to(x[:, None], of.shape)[real] for x in (doc, times))
        of, up, level = of[real], up[real], level[real]
        # A feature in a document is one row, whichever words have it.
        order = np.lexsort((doc, of))
        of, up, level, doc, times = of[order], up[order], level[order], doc[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])])) if len(of) else np.zeros(0, int)
        times = np.add.reduceat(times, new) if len(new) else times
        label, cross = (np.asarray(part.column(c).to_pylist(), np.int64)[doc[new]] for c in ("label", "cross"))
        return {"word": of[new].view(np.int64), "parent": up[new].view(np.int64), "level": level[new].astype(np.int32), "cell": (2 * cross + label).astype(np.int32), "n": times}

    rows = map_slices(sample, count, "word bigint, parent bigint, level int, cell int, n bigint")
    cells = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(2 * CROSS)]
    docs = [F.count_if(F.floor(F.col("cell") / 2) == k).alias(f"d{k}") for k in range(CROSS)]
    counted = rows.groupBy("word", "parent", "level").agg(*cells, *docs)
    wanted = sum((F.col(f"d{k}") for k in range(CROSS)), F.lit(0)) >= LEAST_DOCS
    sizes = materialise(counted, "counts")
    whole = sizes.where(F.col("level") == len(BEGINNINGS)).agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(2 * CROSS)]).first()
    found = sizes.where(wanted).toArrow()
    discard(sizes)
    columns = {c: found[c].to_numpy() for c in found.column_names}
    order = np.argsort(columns["word"].view(np.uint64))
    columns = {c: v[order] for c, v in columns.items()}
    word, up = columns["word"].view(np.uint64), columns["parent"].view(np.uint64)
    columns |= {"word": word, "parent": np.where(up == 0, -1, np.searchsorted(word, up))}
    return columns, np.array(whole, float).reshape(CROSS, 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD, most: int = MOST_LABELLED) -> Model:
    """Log-odds from the labelled sample and the whole corpus, chance statistics, and the curve.

    Every feature in LEAST_DOCS documents of the sample has a score; their number is bounded by the sample's words.
    """
    spark = docs.sparkSession
    cross = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(CROSS)).cast("int").alias("cross")
    sample = materialise(training_sample(docs, labels, label, folds, fold, most).select("doc_id", "label", "text", cross), "sample")
    counted, sizes = _sample_counts(sample)
    corpus, size = _counted(docs, counted["word"])

    def fitted(parts: list[int]) -> Model:
        counts = tuple(sum((counted[f"n{2 * k + c}"] for k in parts), np.zeros(len(corpus))) for c in (0, 1))
        seen = sum((counted[f"d{k}"] for k in parts), np.zeros(len(corpus))) >= LEAST_DOCS
        added = gains(counted["parent"], counted["level"], corpus, size, counts, tuple(sizes[parts].sum(axis=0)))
        return Model(counted["word"][seen], added[seen])

    models = [fitted([j for j in range(CROSS) if j != k]) for k in range(CROSS)]
    rate, scale = chance(spark.sparkContext.broadcast(models), sample)
    for model in models:
        model.rate, model.scale = rate, scale
    shared = spark.sparkContext.broadcast(models)

    def weigh(part: pa.RecordBatch) -> dict:
        e = [shared.value[cross].evidence(shared.value[cross].scores([text])[0])[0].tolist() for text, cross in zip(texts_of(part.column("text")), part.column("cross").to_pylist())]
        return {"doc_id": part.column("doc_id"), "label": part.column("label"), "e": e}

    seen = sorted(map_slices(sample, weigh, "doc_id bigint, label int, e array<double>").collect())
    discard(sample)
    out = fitted(list(range(CROSS)))
    out.rate, out.scale = rate, scale
    if seen:
        out.curve = _logistic(np.array([r["e"] for r in seen]), np.array([r["label"] for r in seen], float))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and passages, the significant segments as (first, end, surprise) in words, for every row of docs.

    Null and empty texts have no segments. Repeated rows and null ids are rows like others; other columns are ignored.
    One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        model = shared.value
        made = [model.evidence(s) for s in model.scores(texts_of(part.column("text")))]
        passages = [[{"first": a, "end": b, "surprise": float(s)} for a, b, s in found] for _, found in made]
        return {"doc_id": part.column("doc_id"), "score": model.score(np.array([e for e, _ in made]).reshape(-1, 4)), "passages": passages}

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, score double, passages array<struct<first:bigint,end:bigint,surprise:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
