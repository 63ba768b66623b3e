"""Metrics of edges, spans, labels, recognisers and latencies, each one grouped pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import labels as L
from tillroll.functions import schema as S
from tillroll.functions import text as X
from tillroll.operators import pages
from tillroll.operators.pairs import precision_recall
from tillroll.operators.spans import bio_spans

THRESHOLDS = [k / 10 for k in range(1, 10)]


def _tally(pred: Column) -> list[Column]:
    gold = F.col("gold") == 1
    return [F.count_if(pred & gold).alias("tp"), F.count_if(pred & ~gold).alias("fp"), F.count_if(~pred & gold).alias("fn")]


def _with_prf(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fp")).alias("predicted"), *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")))


def edge_metrics(pairs: DataFrame, threshold: float = S.THRESHOLD, *keys: str) -> DataFrame:
    """Precision, recall and f1 of edges(prob, gold), of all or by key columns."""
    return _with_prf(pairs.groupBy(*keys).agg(*_tally(F.col("prob") >= threshold)), *keys)


def item_price_metrics(pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """The same of distinct (document, head, dependent) whose dependent is an item's price, whatever the head."""
    some = pairs.where("dep_field = 'ITEM_PRICE'").groupBy("doc_id", "head_span_id", "dep_span_id").agg(F.max("prob").alias("prob"), F.max("gold").alias("gold"))
    return edge_metrics(some, threshold)


def _hard_kinds() -> dict[str, Column]:
    """Which wrong edge counts as what."""
    f, starts = F.col("dep_field"), lambda *names: reduce(or_, [F.col("dep_field").startswith(n) for n in names])
    item = F.col("head_field") == "ITEM_NAME"
    return {
        "store": starts("STORE_"),
        "total_subtotal": starts("TOTAL_", "SUBTOTAL_") | (f == "TAX_PRICE"),
        "tax": starts("TAX_"),
        "summary": starts("TOTAL_", "SUBTOTAL_", "DISCOUNT_", "SERVICE_", "TIP_"),
        "payment": starts("PAYMENT_", "CARD_", "CASH_", "CHANGE_"),
        "item": item,
        "wrong_price": item & f.isin("TOTAL_PRICE", "SUBTOTAL_PRICE", "TAX_PRICE", "TIP_PRICE", "PAYMENT_INFO"),
    }


def hard_negatives(pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """Wrong edges to fields that no item may hold: counts by (head, field), by field, by head, and of all.

    n_item counts those of item names, n_wrong_price those of item names to a sum or payment.
    """
    wrong = pairs.where((F.col("gold") == 0) & (F.col("prob") >= threshold) & L.is_hard_negative_for_items(F.col("dep_field")))
    sets = wrong.withColumns({f"_{k}": c for k, c in _hard_kinds().items()}).groupingSets([["head_field", "dep_field"], ["dep_field"], ["head_field"], []], "head_field", "dep_field")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *[F.count_if(F.col(f"_{k}")).alias(f"n_{k}") for k in _hard_kinds()])


def dependent_collisions(pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """Edges beyond the first of each dependent."""
    each = pairs.where(F.col("prob") >= threshold).groupBy("doc_id", "dep_span_id").agg(F.count("*").alias("n"))
    return each.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("collisions"), F.count_if(F.col("n") > 1).alias("dependents"))


def _tallies(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row of counts at every threshold, as columns with its place behind the name: n edges, tp right ones, hard
    ones to fields that no item may hold, collisions beyond the first of a dependent; and of distinct pairs with an item's
    price, pn and ptp. pos and ppos count true edges and true pairs.

    Edges meet their dependent, then all; both steps stay on the layout by doc_id.
    """
    gold, price = F.col("gold") == 1, F.col("dep_field") == "ITEM_PRICE"
    steps = list(enumerate(thresholds))
    over = lambda c, t: F.col(c) >= t
    each = pairs.groupBy("doc_id", "dep_span_id", "head_span_id").agg(
        F.count_if(gold).alias("pos"),
        F.max(F.when(price, F.col("prob"))).alias("p"),
        F.max(F.when(price, F.col("gold"))).alias("g"),
        *[c.alias(f"{name}{k}") for k, t in steps for name, c in (("n", F.count_if(over("prob", t))), ("tp", F.count_if(over("prob", t) & gold)), ("hard", F.count_if(over("prob", t) & ~gold & L.is_hard_negative_for_items(F.col("dep_field")))))],
    )
    one = each.groupBy("doc_id", "dep_span_id").agg(
        F.sum("pos").alias("pos"),
        F.count_if(F.col("g") == 1).alias("ppos"),
        *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k, _ in steps for c in ("n", "tp", "hard")],
        *[c.alias(f"{name}{k}") for k, t in steps for name, c in (("pn", F.count_if(over("p", t))), ("ptp", F.count_if(over("p", t) & (F.col("g") == 1))))],
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return one.agg(
        total("pos", "pos"),
        total("ppos", "ppos"),
        *[total(f"{c}{k}", f"{c}{k}") for k, _ in steps for c in ("n", "tp", "hard", "pn", "ptp")],
        *[total(F.greatest(F.col(f"n{k}") - 1, F.lit(0)), f"collisions{k}") for k, _ in steps],
    )


def tallies_of(counts: DataFrame, thresholds: list[float], *more: Column) -> DataFrame:
    """The row of _tallies() from counts(head_field, dep_field, step, gold, n) as pages.tallies() makes them, where each
    document has a pair once."""
    at = {t: k for k, t in enumerate(sorted(thresholds), 1)}
    n, edge, gold, price = F.col("n"), F.col("dep_field").isNotNull(), F.col("gold") == 1, F.col("dep_field") == "ITEM_PRICE"
    total = lambda c, name: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).alias(name)
    hard = ~gold & L.is_hard_negative_for_items(F.col("dep_field"))
    out = [total(edge & gold, "pos"), total(price & gold, "ppos")]
    for k, t in enumerate(thresholds):
        over = F.col("step") >= at[t]
        out += [total(edge & over, f"n{k}"), total(edge & over & gold, f"tp{k}"), total(over & hard, f"hard{k}"), total(price & over, f"pn{k}"), total(price & over & gold, f"ptp{k}")]
        out.append((F.coalesce(F.sum(F.when(over, F.when(edge, n).otherwise(-n))), F.lit(0))).alias(f"collisions{k}"))
    return counts.agg(*out, *more)


def _renamed(columns: list[Column], prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}_{name}") for c, name in zip(columns, ("precision", "recall", "f1"))]


def threshold_sweep(pairs: DataFrame, thresholds: list[float] = THRESHOLDS, counted: bool = False) -> DataFrame:
    """At every threshold, from one pass: measures of edges and of pairs with an item's price, wrong edges to fields that
    no item may hold, and collisions. Pairs may be counted already, by pages.tallies() at the same thresholds."""
    return _swept((tallies_of if counted else _tallies)(pairs, thresholds), thresholds)


def _swept(tallied: DataFrame, thresholds: list[float], *more: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), *[F.col(f"{c}{k}").alias(c) for c in ("n", "tp", "hard", "pn", "ptp", "collisions")]) for k, t in enumerate(thresholds)]))
    each = tallied.select("pos", "ppos", *more, rows.alias("r")).select("pos", "ppos", *more, "r.*")
    edge = precision_recall(F.col("tp"), F.col("n") - F.col("tp"), F.col("pos") - F.col("tp"))
    pair = precision_recall(F.col("ptp"), F.col("pn") - F.col("ptp"), F.col("ppos") - F.col("ptp"))
    return each.select("threshold", *_renamed(edge, "edge"), *_renamed(pair, "pair"), F.col("hard").alias("hard_negatives"), "collisions", *more)


def best_threshold(pairs: DataFrame, thresholds: list[float] = THRESHOLDS, counted: bool = False) -> DataFrame:
    """The threshold with the best f1 of pairs with an item's price, then their precision, then the fewest wrong edges to
    fields that no item may hold, then the least."""
    return threshold_sweep(pairs, thresholds, counted).orderBy(F.desc("pair_f1"), F.desc("pair_precision"), "hard_negatives", "threshold").limit(1)


def evaluation(pairs: DataFrame, threshold: float = S.THRESHOLD, counted: bool = False) -> DataFrame:
    """One row that sums up the edges of all documents: pairs, measures of edges, of pairs with an item's price and of
    edges to sums, wrong edges by kind, and collisions. counted: see threshold_sweep()."""
    over, gold = F.col("step") >= 1 if counted else F.col("prob") >= threshold, F.col("gold") == 1
    sums = F.col("dep_field").isin(*S.SUMMARY_DEPENDENTS)
    wrong = over & ~gold & L.is_hard_negative_for_items(F.col("dep_field"))
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) if counted else F.count_if(c)
    kinds = {
        "n_pairs": tally(F.col("dep_field").isNotNull()) if counted else F.count("*"),
        "n_positive": tally(gold),
        **{n: tally(sums & c) for n, c in (("stp", over & gold), ("sfp", over & ~gold), ("sfn", ~over & gold))},
        **{f"hard_{k}": tally(wrong & c) for k, c in _hard_kinds().items()},
    }
    kinds = [c.alias(n) for n, c in kinds.items()]
    names = ["n_pairs", "n_positive", "stp", "sfp", "sfn", *[f"hard_{k}" for k in _hard_kinds()]]
    whole = _swept(tallies_of(pairs, [threshold], *kinds), [threshold], *names) if counted else threshold_sweep(pairs, [threshold]).join(F.broadcast(pairs.agg(*kinds)))
    summary = _renamed(precision_recall(F.col("stp"), F.col("sfp"), F.col("sfn")), "summary")
    return whole.select("threshold", "n_pairs", "n_positive", *[f"{a}_{b}" for a in ("edge", "pair") for b in ("precision", "recall", "f1")], *summary, "hard_negatives", *[f"hard_{k}" for k in _hard_kinds()], "collisions")


def counted_edge_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """edge_metrics() by key columns from the numbers of pages.tallies() at one threshold, and hard_negatives, wrong edges
    to fields that no item may hold."""
    over, gold = F.col("step") >= 1, F.col("gold") == 1
    tally = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hard = tally(over & ~gold & L.is_hard_negative_for_items(F.col("dep_field")))
    made = counts.where("dep_field IS NOT NULL").groupBy(*keys).agg(*[tally(c).alias(n) for n, c in (("tp", over & gold), ("fp", over & ~gold), ("fn", ~over & gold))], hard.alias("hard_negatives"))
    return _with_prf(made, *keys, "hard_negatives")


def matched_span_metrics(matched: DataFrame, gold: DataFrame) -> DataFrame:
    """By field: the share of predicted spans whose matched gold line has their field, and of gold lines that such a span
    matches. matched(doc_id, field, gold_id, gold_field), the latter two null without a match; gold(doc_id, gold_id, field).
    """
    right = F.col("gold_field") == F.col("field")
    found = matched.groupBy("field").agg(F.count("*").alias("pred"), F.count_if(right).alias("correct"), F.count_distinct(F.when(right, F.struct("doc_id", "gold_id"))).alias("matched"))
    both = found.join(gold.groupBy("field").agg(F.count("*").alias("gold")), "field", "full_outer").na.fill(0)
    return matched_span_ratios(both)


def matched_span_ratios(counts: DataFrame) -> DataFrame:
    """The same from counts(field, pred, gold, correct, matched) of parts of the documents."""
    both = counts.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("pred", "gold", "correct", "matched")])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("field", "pred", "gold", "correct", "matched", ratio("correct", "pred").alias("precision"), ratio("matched", "gold").alias("recall"))


def strict_span_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """By field, spans that agree in document, field and both ends."""
    key = ["doc_id", "field", "first_word", "last_word"]
    both = gold.select(*key).distinct().withColumn("g", F.lit(1)).join(pred.select(*key).distinct().withColumn("p", F.lit(1)), key, "full_outer")
    counts = both.groupBy("field").agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return _with_prf(counts, "field")


def relaxed_span_metrics(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """By field, predicted spans that overlap a gold span of their field that no earlier one has taken.

    The choice is greedy in order; documents are worked on many at a time, see pages.taken().
    """
    side = lambda df, pred: df.select("doc_id", "field", "first_word", "last_word", F.lit(pred).alias("pred"))
    return relaxed_of(pages.by_document(side(gold, False).unionByName(side(pred, True)), pages.overlaps, pages.OVERLAPS))


def relaxed_of(counts: DataFrame) -> DataFrame:
    """The same from counts(field, tp, fp, fn) of parts of the documents."""
    return _with_prf(counts.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]), "field")


def token_field_metrics(words: DataFrame, gold: str, pred: str) -> DataFrame:
    """By field, words that both label with it."""
    fields = words.select(L.label_field(F.col(gold)).alias("g"), L.label_field(F.col(pred)).alias("p"))
    hit = fields.groupBy("g", "p").agg(F.count("*").alias("n"))
    sides = hit.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("field"), "g", "p", "n").where("field <> 'O'")
    counts = sides.groupBy("field").agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("tp", F.col("g") == F.col("p")), ("fp", F.col("g") != F.col("field")), ("fn", F.col("p") != F.col("field")))])
    return _with_prf(counts, "field")


def label_confusions(words: DataFrame, gold: str, pred: str, k: int = 50, diagonal_first: bool = True) -> DataFrame:
    """The k commonest pairs of labels; equal labels take places among them first and go then, or never take any."""
    pairs = words.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    top = lambda df: df.orderBy(F.desc("n"), "gold", "pred").limit(k)
    return top(pairs).where("gold <> pred") if diagonal_first else top(pairs.where("gold <> pred"))


def boundary_errors(words: DataFrame, gold: str, pred: str) -> DataFrame:
    """By field, labels of the right field that begin or go on where they should not."""
    g, p = F.col(gold), F.col(pred)
    field = F.regexp_replace(g, "^[BI]-", "")
    same = words.where((g != "O") & (F.regexp_replace(p, "^[BI]-", "") == field)).withColumn("field", field)
    return same.groupBy("field").agg(F.count_if(g.startswith("B-") & p.startswith("I-")).alias("b_as_i"), F.count_if(g.startswith("I-") & p.startswith("B-")).alias("i_as_b"), F.count("*").alias("n"))


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean, exact median and 95th percentile (interpolated) and count."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.count(value).alias("n"))


def compare_tokens(df: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """Adds the measures of a recognised text against the truth."""
    t, f = F.col(truth), F.col(found)
    return df.select(
        "*",
        F.levenshtein(f, t).alias("distance"),
        X.cer(t, f).alias("cer"),
        X.character_accuracy(t, f).alias("char_accuracy"),
        (t == f).alias("exact"),
        (X.digits(t) == X.digits(f)).alias("digits_match"),
        X.is_numeric_token(t).alias("numeric"),
        X.count_mismatch(t, f, ".,-:/").alias("punctuation"),
        X.count_mismatch(t, f, ".").alias("decimals"),
    )


def summarise_models(compared: DataFrame) -> DataFrame:
    """By model, means over all tokens and over numeric ones.

    The best is first: by exact matches of numeric tokens, their CER, exact matches of all, then name.
    """
    number = lambda c: F.avg(F.when(F.col("numeric"), c))
    exact = F.col("exact").cast("double")
    made = compared.groupBy("model").agg(F.count("*").alias("n"), F.avg("cer").alias("cer"), F.avg("char_accuracy").alias("char_accuracy"), F.avg(exact).alias("exact_rate"), number(F.col("cer")).alias("numeric_cer"), number(F.col("digits_match").cast("double")).alias("digit_rate"), number(exact).alias("numeric_exact"))
    none = lambda c, v: F.coalesce(c, F.lit(v))
    return made.orderBy(none("numeric_exact", 0.0).desc(), none("numeric_cer", 999.0), none("exact_rate", 0.0).desc(), "model").drop("numeric_exact")


def character_confusions(df: DataFrame, truth: str = "truth", found: str = "found") -> DataFrame:
    """By model, how often a character of the truth was read as its look-alike at the same place."""
    pairs = [f"{a}>{b}" for x, y in X.CONFUSIONS for a, b in ((x, y), (y, x))]
    zipped = F.arrays_zip(F.split(F.col(truth), "").alias("t"), F.split(F.col(found), "").alias("f"))
    each = df.select("model", F.explode(zipped).alias("x")).select("model", F.concat_ws(">", F.col("x.t"), F.col("x.f")).alias("pair"))
    return each.where(F.col("pair").isin(*pairs)).groupBy("model", "pair").agg(F.count("*").alias("n"))




def token_metrics(words: DataFrame, gold: str, pred: str) -> DataFrame:
    """One row: tokens, right ones, accuracy, and measures of the spans that the labels stand for, as wholes and of any field."""
    tokens = words.agg(F.count("*").alias("n_tokens"), F.count_if(F.col(gold) == F.col(pred)).alias("n_correct"))
    key = ["doc_id", "field", "first_word", "last_word"]
    spans = lambda label, name: bio_spans(words, label).select(*key).distinct().withColumn(name, F.lit(1))
    both = spans(gold, "g").join(spans(pred, "p"), key, "full_outer")
    counts = both.agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    accuracy = F.when(F.col("n_tokens") > 0, F.col("n_correct") / F.col("n_tokens")).otherwise(0.0).alias("accuracy")
    return tokens.join(F.broadcast(counts)).select("n_tokens", "n_correct", accuracy, *_renamed(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), "span"))


def flattened(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each number of each row: the keys, metric and value."""
    names = [c for c in df.columns if c not in keys]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]))
    return df.select(*keys, each.alias("m")).select(*keys, "m.*")


def differences(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """By key, the greatest and mean absolute difference of two numbers, and how many there are; such rows merge."""
    diff = F.abs(F.col(a) - F.col(b))
    return df.groupBy(*keys).agg(F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"), F.count(diff).alias("n"))


def verdicts(df: DataFrame, f1: str = "f1", hard: str = "hard_negatives", collisions: str = "collisions") -> DataFrame:
    """Adds verdict, strong from an f1 of 0.9, usable from 0.8, else review; and notes on what remains."""
    band = F.when(F.col(f1) >= 0.9, "strong").when(F.col(f1) >= 0.8, "usable").otherwise("review")
    notes = F.array_compact(F.array(F.when(F.col(hard) > 0, "hard negatives remain"), F.when(F.col(collisions) > 0, "dependents collide")))
    return df.withColumn("verdict", band).withColumn("notes", F.array_join(notes, ", "))


def best_checkpoint(df: DataFrame, run: str, value: str, order: str, greater: bool = True) -> DataFrame:
    """By run, the row with the greatest (or least) value, the first of equal ones."""
    rank = F.struct((F.col(value) if not greater else -F.col(value)).alias("v"), F.col(order).alias("o"))
    return df.groupBy(run).agg(F.min_by(order, rank).alias(order), F.min_by(value, rank).alias(value))
