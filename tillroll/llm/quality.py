"""Quality rules as a ledger: every rule once, its failure as a bit, its measurements as columns.

A policy is a bit mask over the ledger, so a new policy, or what one rule of a policy costs, needs no second look at
the texts.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm._common import map_slices

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")

#: Bit by position. Each rule compares whole numbers, so that engines agree on it.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "capitals": "n_letters >= 20 AND 2 * n_upper > n_letters",
}
BASE = ("too_few_words", "repeated_windows")

#: Rules that reject, by version of the policy; every version rejects what the base rules do.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "word_length", "symbols"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_LOWER, _REST = bytes(range(97, 123)), bytes(range(128, 192))


def _continuation(data: bytes) -> int:
    """Bytes of UTF-8 that begin no code point; none of them is white space."""
    return 0 if data.isascii() else len(data) - len(data.translate(None, _REST))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many consecutive words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    counts = Counter(zip(*(words[k:] for k in range(window))))
    if len(counts) == n:
        return 0
    covered, total = 0, 0  # covered: first word that no repeated window has reached yet
    for at, found in enumerate(zip(*(words[k:] for k in range(window)))):
        if counts[found] > 1:
            total += at + window - max(at, covered)
            covered = at + window
    return total


def measure(text: str | None) -> tuple[int, ...]:
    """MEASURES of one whole text; null is empty."""
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    letters = data.translate(None, _LOWER)
    return (
        len(words),
        sum(map(len, words)) - _continuation(data),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(letters.translate(None, _UPPER)),
        len(letters) - len(letters.translate(None, _UPPER)),
    )


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def ledger(docs: DataFrame, keep: str | None = None) -> DataFrame:
    """doc_id, the measurements and failures, a long with a bit for each failed rule, of every row of docs.

    Null and empty texts have no words and fail too_few_words. Repeated rows and null ids are rows like others; other
    columns are ignored, unless keep names a column to carry the whole input row in. One pass, no shuffle.
    """
    row = [F.struct("*").alias("row")] if keep else []

    def scan(part: pa.RecordBatch) -> dict:
        out = {"row": part.column("row")} if keep else {}
        made = [measure(t) for t in part.column("text").to_pylist()]
        return out | {"doc_id": part.column("doc_id")} | {name: [m[k] for m in made] for k, name in enumerate(MEASURES)}

    schema = f"row {docs.schema.simpleString()}, " * bool(keep) + "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
    measured = map_slices(docs.select(*row, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, schema)
    failed = reduce(Column.bitwiseOR, [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, rule in enumerate(RULES.values())])
    out = measured.withColumn("failures", failed)
    return out.withColumnRenamed("row", keep) if keep else out


def rejected(policy: str = CURRENT) -> Column:
    """Whether a policy rejects a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(bits(POLICIES[policy]))) != 0


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and whether any or all fail it.

    One pass of bitwise aggregates over the ledger; a row for each rule, zeros on an empty ledger.
    """
    mask = bits(POLICIES[policy])
    f = F.col("failures").bitwiseAND(F.lit(mask))
    one = entries.agg(
        F.coalesce(F.bit_or(f), F.lit(0)).alias("any"),
        F.coalesce(F.bit_and(f), F.lit(0)).alias("all"),
        *[F.count_if(f.bitwiseAND(F.lit(1 << k)) != 0).alias(f"failed_{k}") for k in range(len(RULES))],
        *[F.count_if(f == (1 << k)).alias(f"only_{k}") for k in range(len(RULES))],
    )
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"failed_{k}").alias("n_failed"), F.col(f"only_{k}").alias("n_only"), (F.col("any").bitwiseAND(F.lit(1 << k)) != 0).alias("any_failed"), (F.col("all").bitwiseAND(F.lit(1 << k)) != 0).alias("all_failed")) for k, name in enumerate(RULES) if name in POLICIES[policy]]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def quality_report(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The contract's columns: counts, base_failed and kept under a policy, and the failure bits."""
    base = F.col("failures").bitwiseAND(F.lit(bits(BASE))) != 0
    return ledger(docs).select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & ~rejected(policy)).alias("kept"), "failures")
