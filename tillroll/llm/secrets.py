"""Secrets: all rules as minimal automata over bytes, whose transition arrays give where matches begin and end."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import map_slices, texts_of
from tillroll.llm.dfa import Rule, Scanner

#: Rules in the order in which spans that begin together are listed, those of a row in one automaton; the first row are
#: the base kinds. All of them in one would have 31,458 states instead of 537 and 1,960, as their repeats count alike bytes.
RULES = [
    [
        Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", any_case=True, head=r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", least=6),
        Rule("access", r"AKIA[A-Z0-9]{16,}"),
        Rule("hex", r"[0-9a-f]{24,}"),
    ],
    [
        Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
        Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
        Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?"),
    ],
]
KINDS = tuple(rule.name for row in RULES for rule in row)
BASE = KINDS[:3]

#: Text that is scanned at once, so that many lanes step together.
SCAN_BYTES = 8 << 20


@functools.cache
def scanner() -> Scanner:
    return Scanner(RULES)


def secret_spans(texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """For each UTF-8 text its (kind, start, end) by start, then kind; code points, end exclusive."""
    out = []
    for text, found in zip(texts, scanner().find(texts)):
        if found and not text.isascii():
            points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])  # code points before a byte
            found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
        out.append([(KINDS[k], a, b) for a, k, b in found])
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) of every whole text.

    A row for each row of docs, repeated ones and null ids included; null and empty texts have none. Other columns are
    ignored. One pass without a shuffle.
    """

    def scan(part: pa.RecordBatch) -> dict:
        found = secret_spans(texts_of(part.column("text")))
        return {"doc_id": part.column("doc_id"), "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]}

    return map_slices(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>", most=SCAN_BYTES)


def secrets_report(docs: DataFrame) -> DataFrame:
    """The counts of base kinds, the digest of base spans and all spans as one string, from find_secrets()."""
    spans = F.col("spans")
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return find_secrets(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"))
