"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. A passage is encoded from counts of its characters and words; gated
attention, learnt from the documents' labels alone, weighs the passages, and the weighted sum of their codes is scored:
a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), score = sigmoid(c . sum_k a_k h_k + b).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import discard, map_slices, materialise, texts_of
from tillroll.llm.hashing import rough_word_hashes, word_edges
from tillroll.llm.labelled import held_out, training_sample

PASSAGE = 64
#: Labelled documents that the model is fitted on, at most, and their passages, at most: some 100 MB in the driver.
MOST_LABELLED, MOST_PASSAGES = 8000, 400_000
FOLDS, FOLD = 4, 2
THRESHOLD = 0.7
HIDDEN, GATE, STEPS, BATCH, RATE = 16, 8, 1200, 256, 0.01
#: Buckets of word hashes beside the counts.
BUCKETS = 32

#: Classes of bytes that are counted.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b".,;:",
    b"!?",
    b"#*$%&",
    b"|<>",
    b"\n",
    bytes(range(128, 256)),
)
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
N_FEATURES = len(_CLASSES) + 8 + BUCKETS


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text, one at least."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, start = rough_word_hashes(raw)
    length = word_edges(raw)[1] - start + 1  # with the space behind
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(start, ends, "left"), prepend=0)
    n = np.maximum(1, (counts + PASSAGE - 1) // PASSAGE)
    doc = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first_word = np.concatenate([[0], np.cumsum(counts)])[doc] + PASSAGE * within
    words = np.minimum(PASSAGE, counts[doc] - PASSAGE * within)
    # A passage's bytes reach to the next passage's first word, or to the end of its text.
    edges = np.append(start, len(raw))
    low = np.where(words > 0, edges[np.minimum(first_word, len(start))], ends[doc] - 1)
    last = np.append(doc[1:] != doc[:-1], True)
    high = np.where(last, ends[doc] - 1, np.append(low[1:], 0))
    size = np.maximum(high - low, 1)
    x = np.zeros((len(doc), N_FEATURES), np.float32)
    kinds = _CLASS[raw]
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kinds == k)])
        x[:, k] = 10 * (total[np.maximum(high, low)] - total[low]) / size
    k = len(_CLASSES)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(len(doc)), words)
    upper = np.isin(kinds[start], [0])
    x[:, k] = size / some / 4
    x[:, k + 1] = np.log1p(words) / 2
    x[:, k + 2] = np.log1p(n[doc]) / 2
    x[:, k + 3] = 4 * np.bincount(owner, upper, len(doc)) / some
    # Words that the passage, and pairs of words that the text, had before.
    order = np.lexsort((hashes, owner))
    again = np.zeros(len(hashes), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    x[:, k + 4] = 4 * np.bincount(owner, again, len(doc)) / some
    pairs = hashes.copy()
    pairs[:-1] = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    last = (np.cumsum(counts) - 1)[counts > 0]
    pairs[last] = hashes[last]  # no word of its text follows
    text = doc[owner]
    order = np.lexsort((pairs, text))
    again[:] = False
    again[order[1:]] = (pairs[order[1:]] == pairs[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    x[:, k + 5] = 4 * np.bincount(owner, again, len(doc)) / some
    mean = np.bincount(owner, length, len(doc)) / some
    x[:, k + 6] = np.sqrt(np.maximum(0, np.bincount(owner, length.astype(float) ** 2, len(doc)) / some - mean**2)) / 4
    x[:, k + 7] = words == 0
    cells = np.bincount(owner * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=len(doc) * BUCKETS)
    x[:, k + 8 :] = 4 * cells.reshape(-1, BUCKETS) / some[:, None]
    return np.clip(x, -10, 10), n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    """The model's arrays, and its forward and backward passes over bags that follow each other."""

    arrays: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, mean: np.ndarray, spread: np.ndarray, seed: int = 1) -> Attention:
        r = np.random.default_rng(seed)
        shape = {"E": (len(mean), HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
        return cls({"mean": mean, "spread": spread} | {k: r.normal(0, 1 / np.sqrt(s[0]), s) * (k in "EVUwc") for k, s in shape.items()})

    def forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        a = self.arrays
        first = np.cumsum(n) - n
        bag = np.repeat(np.arange(len(n)), n)
        x = (x - a["mean"]) / a["spread"]
        h = np.tanh(x @ a["E"] + a["e"])
        t, g = np.tanh(h @ a["V"]), _sigmoid(h @ a["U"])
        s = (t * g) @ a["w"]
        s = np.exp(s - np.maximum.reduceat(s, first)[bag])
        weight = s / np.add.reduceat(s, first)[bag]
        z = np.add.reduceat(weight[:, None] * h, first)
        return {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "bag": bag, "first": first, "score": _sigmoid(z @ a["c"] + a["b"])}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        a = self.arrays
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * a["c"]
        through = (dz[f["bag"]] * f["h"]).sum(1)
        ds = f["weight"] * (through - np.add.reduceat(f["weight"] * through, f["first"])[f["bag"]])
        dt, dg = ds[:, None] * a["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * a["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["weight"][:, None] * dz[f["bag"]] + dt @ a["V"].T + dg @ a["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ds @ (f["t"] * f["g"]), "c": f["z"].T @ d, "b": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Attention:
    """Fit by Adam on cross-entropy; the order of batches follows from the seed. No bags, or one class, give the base rate."""
    if not bags:
        return Attention.fresh(np.zeros(N_FEATURES), np.ones(N_FEATURES), seed)
    every = np.concatenate(bags).astype(np.float64)
    model = Attention.fresh(every.mean(0), every.std(0) + 0.05, seed)
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in model.arrays.items()} for _ in range(2))
    share = np.clip(y.mean(), 0.01, 0.99)
    model.arrays["b"][:] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        for step in range(1, STEPS + 1):
            some = r.integers(0, len(bags), min(BATCH, len(bags)))
            f = model.forward(np.concatenate([bags[i] for i in some]).astype(np.float64), np.array([len(bags[i]) for i in some]))
            for k, d in model.gradients(f, y[some]).items():
                d = d + 1e-4 * model.arrays[k] * (k != "b")
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                model.arrays[k] -= RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    else:
        model.arrays["c"][:] = 0
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = FOLD, most: int = MOST_LABELLED, most_passages: int = MOST_PASSAGES) -> Attention:
    """Fit the model on a bounded sample of labelled documents; executors encode them, the driver gets the codes.

    The sample is at most so many documents, in order of a hash of their ids, and of these, in that order, each that still
    fits into so many passages; a document with more of them than that teaches nothing.
    """
    sample = training_sample(docs, labels, label, folds, fold, most)

    def encode(part: pa.RecordBatch) -> dict:
        x, n = passages(texts_of(part.column("text")))
        ends = np.cumsum(n)
        return {"doc_id": part.column("doc_id"), "label": part.column("label"), "n": n, "x": [x[e - k : e].astype("<f4").tobytes() for e, k in zip(ends, n)]}

    coded = materialise(map_slices(sample, encode, "doc_id bigint, label int, n bigint, x binary"), "passages")
    size, taken = 0, []
    for row in coded.select(F.xxhash64("doc_id", "x").alias("h"), "n").orderBy(F.xxhash64("doc_id"), "doc_id", "h").collect():
        if size + row["n"] <= most_passages:
            size += row["n"]
            taken.append(row["h"])
    chosen = docs.sparkSession.createDataFrame([(h,) for h in taken], "h bigint")
    rows = sorted(coded.withColumn("h", F.xxhash64("doc_id", "x")).join(F.broadcast(chosen), "h", "left_semi").select("doc_id", "label", "x").collect())
    discard(coded)
    return fit([np.frombuffer(r["x"], "<f4").reshape(-1, N_FEATURES) for r in rows], np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Attention) -> DataFrame:
    """doc_id, score and weights, the attention of each passage, for every row of docs.

    Null and empty texts are one passage without words. Repeated rows and null ids are rows like others; other columns
    are ignored. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> dict:
        x, n = passages(texts_of(part.column("text")))
        f = shared.value.forward(x.astype(np.float64), n)
        return {"doc_id": part.column("doc_id"), "score": f["score"], "weights": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(f["weight"]))}

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id bigint, score double, weights array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
