"""Curation of labelled receipts: item-name policy, relation repair and routing, item categories, record checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll.functions import labels as L
from tillroll.operators import pages as D

#: Rules and overrides that are held in a plan; more are joined.
RULES_IN_PLAN = 1000

#: What a word labelled as an item's name becomes, by the first kind that it is.
IN_NAME = [
    ("service", "SERVICE_NAME"),
    ("membership", "PAYMENT_INFO"),
    ("placeholder", "ITEM_ETC"),
    ("category header", "ITEM_CATEGORY"),
    ("size", "ITEM_OPTION"),
    ("price", "ITEM_PRICE"),
    ("quantity", "ITEM_QTY"),
    ("tax flag", "ITEM_TAX_FLAG"),
    ("strong code", "ITEM_CODE"),
]
#: What a word without a label becomes beside an item's name and price; a price only beside a quantity too.
IN_ROW = [
    ("code", "ITEM_CODE"),
    ("size", "ITEM_OPTION"),
    ("quantity", "ITEM_QTY"),
    ("price", "ITEM_UNIT_PRICE"),
]


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F
    for condition, value in cases:
        out = out.when(condition, value)
    return out


def item_policy(words: DataFrame, row: str = "line_no", together: bool = False) -> DataFrame:
    """Adds new_field and reason (null: unchanged) to words(doc_id, word_idx, text, field, row).

    First each word of an item's name that is something else takes that field; a whole run of name words in one row
    that is an option phrase becomes an option. Then in rows that still have a name and a price, unlabelled codes,
    sizes, quantities and, beside a quantity, prices are labelled. A null field counts as O, a null text as empty, and a
    word of no row stands alone. text and field are strings, other columns of any type that Arrow has. Documents are worked
    on whole, by arrays; together as in pages.by_document().
    """
    schema = T.StructType([*words.schema.fields, T.StructField("new_field", T.StringType()), T.StructField("reason", T.StringType())])
    return D.by_document(words, D.policies(words.columns, row, IN_NAME, IN_ROW), schema, together)


def repair_relations(relations: DataFrame, words: DataFrame) -> DataFrame:
    """relations(doc_id, relation_id, head_field, head_words, tail_field, tail_words) held against words(..., field, box).

    Each side keeps the words that exist and have its declared field (any word if that is O); kept tells whether both
    sides have some. Texts, boxes and warnings are made anew. relation_id is unique in a document; a null or empty side
    is missing. The words of a side are joined one by one, never gathered by document.
    """
    side = lambda s: F.struct(F.lit(s).alias("side"), L.canonical_field(F.col(f"{s}_field")).alias("declared"), F.col(f"{s}_words").alias("given"))
    sides = relations.select("doc_id", "relation_id", F.explode(F.array(side("head"), side("tail"))).alias("s")).select("doc_id", "relation_id", "s.*")
    given = sides.select("doc_id", "relation_id", "side", "declared", F.posexplode_outer("given").alias("pos", "word_idx"))
    known = words.select("doc_id", "word_idx", F.coalesce("field", F.lit("O")).alias("field"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), "x0", "y0", "x1", "y1")
    found = given.join(known, ["doc_id", "word_idx"], "left")
    fits = F.col("field").isNotNull() & ((F.coalesce("declared", F.lit("O")) == "O") | (F.col("field") == F.col("declared")))
    out = []
    for s in ("head", "tail"):
        here, good = F.col("side") == s, (F.col("side") == s) & fits
        out += [F.count_if(here & F.col("word_idx").isNotNull()).alias(f"{s}_given"), F.count_if(here & F.col("field").isNotNull()).alias(f"{s}_valid"), F.max(F.when(here, F.col("declared"))).alias(f"{s}_field")]
        out += [F.array_sort(F.collect_list(F.when(good, F.struct("pos", "word_idx", "text")))).alias(s)]
        out += [f(F.when(good, F.col(c))).alias(f"{s}_{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    made = found.groupBy("doc_id", "relation_id").agg(*out)
    columns, warnings = [], []
    for s in ("head", "tail"):
        columns += [f"{s}_field", F.transform(s, lambda w: w["word_idx"]).alias(f"{s}_words"), F.trim(F.array_join(F.transform(s, lambda w: w["text"]), " ")).alias(f"{s}_text"), *[f"{s}_{c}" for c in ("x0", "y0", "x1", "y1")]]
        n_given, n_valid = F.col(f"{s}_given"), F.col(f"{s}_valid")
        warnings += [F.when(n_given == 0, f"{s}: no words"), F.when(n_valid < n_given, f"{s}: word out of range"), F.when((n_valid > 0) & (F.size(s) == 0), f"{s}: no word of its field")]
    return made.select("doc_id", "relation_id", *columns, F.array_compact(F.array(*warnings)).alias("warnings"), ((F.size("head") > 0) & (F.size("tail") > 0)).alias("kept"))


def link_words(words: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds relation_ids to words: those of the relations that hold the word on a side, sorted, each once."""
    both = F.array_union(F.coalesce("head_words", F.array().cast("array<int>")), F.coalesce("tail_words", F.array().cast("array<int>")))
    links = relations.select("doc_id", F.explode(both).alias("word_idx"), "relation_id")
    links = links.groupBy("doc_id", "word_idx").agg(F.array_sort(F.collect_set("relation_id")).alias("relation_ids"))
    return words.join(links, ["doc_id", "word_idx"], "left").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))


def route_decisions(decisions: DataFrame) -> DataFrame:
    """Adds relation_id, relation_type, route and edge_id to decisions(doc_id, source, ordinal, relation_type, head_field).

    Sources count in the order item, summary, payment, other; ids run in that order within a document. A relation of
    type item_attribute under an ITEM_NAME is an edge too. Rows of equal source and ordinal have no order among them.
    """
    source = F.col("source")
    kind = F.coalesce("relation_type", F.when(source == "summary", "summary_amount").when(source == "payment", "payment_attribute").otherwise("item_attribute"))
    route = F.when((source == "summary") | F.col("relation_type").isin("summary_amount", "tax_amount"), "summary").when((source == "payment") | F.col("relation_type").startswith("payment"), "payment").otherwise("item")
    rank = F.when(source == "item", 0).when(source == "summary", 1).when(source == "payment", 2).otherwise(3)
    order = Window.partitionBy("doc_id").orderBy("_rank", "ordinal")
    held = decisions.withColumn("relation_type", kind).withColumn("_rank", rank).withColumn("route", route)
    edge = (F.col("relation_type") == "item_attribute") & F.coalesce(F.col("head_field") == "ITEM_NAME", F.lit(False))
    held = held.withColumn("relation_id", F.format_string("r_%06d", F.row_number().over(order) - 1))
    upto = F.sum(edge.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return held.withColumn("edge_id", F.when(edge, F.format_string("g_%06d", upto))).drop("_rank")


def item_text(text: Column) -> Column:
    """Upper-case words of letters and digits, split where a small letter meets a capital."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z])(?=[A-Z])", " ")
    return F.upper(F.trim(F.regexp_replace(F.replace(apart, F.lit("&"), F.lit(" AND ")), "[^0-9A-Za-z]+", " ")))


def categorise(df: DataFrame, text: str, rules: list[tuple[str, float, str]], overrides: dict[str, str] | None = None) -> DataFrame:
    """Adds category, category_confidence and category_rule by rules (category, confidence, keyword), the first match first.

    A keyword matches as whole words, or one of 6 or more characters anywhere in the text without its spaces. Overrides
    give whole texts a category with confidence 1. Else OTHER, 0.35, or 0 for an empty or null text. Up to RULES_IN_PLAN
    rules are literals of the plan, so that no join or shuffle is needed; more are joined to the distinct texts' runs of
    words and of characters, with the same result.
    """
    overrides = overrides or {}
    out = df.withColumn("_text", item_text(F.col(text)))
    if len(rules) + len(overrides) > RULES_IN_PLAN:
        return _categorise_by_join(df.columns, out, rules, overrides)
    known = [F.struct(F.lit(c).alias("category"), F.lit(float(p)).alias("confidence"), F.lit(k).alias("rule"), item_text(F.lit(k)).alias("key")) for c, p, k in rules]
    padded, short = F.concat(F.lit(" "), F.col("_text"), F.lit(" ")), F.replace(F.col("_text"), F.lit(" "), F.lit(""))

    def matches(r: Column) -> Column:
        key = F.replace(r["key"], F.lit(" "), F.lit(""))
        return (r["key"] != "") & (F.contains(padded, F.concat(F.lit(" "), r["key"], F.lit(" "))) | ((F.length(key) >= 6) & F.contains(short, key)))

    result = lambda category, confidence, rule: F.struct(category.alias("category"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))
    cases = [(F.col("_text") == "", result(F.lit("OTHER"), 0.0, "empty"))]
    if overrides:
        pairs = [F.struct(item_text(F.lit(k)).alias("key"), F.lit(v).alias("value")) for k, v in overrides.items()]
        chosen = F.try_element_at(F.filter(F.array(*pairs), lambda p: p["key"] == F.col("_text")), F.lit(-1))["value"]
        cases.append((chosen.isNotNull(), result(chosen, 1.0, "override")))
    if known:
        first = F.try_element_at(F.filter(F.array(*known), matches), F.lit(1))
        cases.append((first.isNotNull(), F.struct(first["category"].alias("category"), first["confidence"].alias("confidence"), first["rule"].alias("rule"))))
    found = out.withColumn("_found", _first(cases).otherwise(result(F.lit("OTHER"), 0.35, "none")))
    return found.select(*[F.col(c) for c in df.columns], F.col("_found.category").alias("category"), F.col("_found.confidence").alias("category_confidence"), F.col("_found.rule").alias("category_rule"))


def _categorise_by_join(columns: list[str], out: DataFrame, rules: list[tuple[str, float, str]], overrides: dict[str, str]) -> DataFrame:
    """categorise() for many rules: keywords meet equal runs of a text's words, long ones equal runs of its characters."""
    spark = out.sparkSession
    # An override comes before all rules, the last of equal ones first.
    rows = [(k - len(overrides), v, 1.0, "override", name, True) for k, (name, v) in enumerate(reversed(overrides.items()))]
    rows += [(k, c, float(p), key, key, False) for k, (c, p, key) in enumerate(rules)]
    table = spark.createDataFrame(rows, "place bigint, category string, confidence double, rule string, name string, whole boolean").withColumn("key", item_text(F.col("name")))
    table = table.where("key <> ''").withColumn("short", F.replace("key", F.lit(" "), F.lit("")))
    size = table.agg(F.max(F.size(F.split("key", " "))), F.collect_set(F.when(F.length("short") >= 6, F.length("short")))).first()  # lengths of keywords
    texts = out.where("_text <> ''").select("_text").distinct().withColumn("_words", F.split("_text", " ")).withColumn("_short", F.replace("_text", F.lit(" "), F.lit("")))
    starts = lambda n, of: F.when(of >= n, F.sequence(F.lit(1), of - n + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(F.array(*[F.transform(starts(n, F.size("_words")), lambda i: F.array_join(F.slice("_words", i, n), " ")) for n in range(1, (size[0] or 0) + 1)]))
    parts = F.flatten(F.array(*[F.transform(starts(n, F.length("_short")), lambda i: F.substring("_short", i, F.lit(n))) for n in sorted(size[1] or [])]))
    found = [texts.join(table.where("whole"), F.col("_text") == F.col("key")).select("_text", "place")]
    if size[0]:
        found.append(texts.select("_text", F.explode(grams).alias("key")).join(table.where("NOT whole"), "key").select("_text", "place"))
    if size[1]:
        found.append(texts.select("_text", F.explode(parts).alias("short")).join(table.where("NOT whole"), "short").select("_text", "place"))
    best = reduce(DataFrame.unionByName, found).groupBy("_text").agg(F.min("place").alias("place")).join(table, "place").select("_text", "category", "confidence", "rule")
    joined = out.join(best, "_text", "left")
    none = F.col("_text") == ""
    return joined.select(
        *[F.col(c) for c in columns],
        F.coalesce("category", F.lit("OTHER")).alias("category"),
        F.when(none, 0.0).otherwise(F.coalesce("confidence", F.lit(0.35))).alias("category_confidence"),
        F.when(none, "empty").otherwise(F.coalesce("rule", F.lit("none"))).alias("category_rule"),
    )


def record_errors(records: DataFrame, labels: list[str]) -> DataFrame:
    """Adds errors to records(words, boxes, normalized_boxes, labels), whose arrays should be equally long.

    Told are empty words, unequal lengths, and the place of the first unknown label, empty or broken box, and box beyond
    0 to 1000. IGNORE is a known label; a null array counts as an empty one.
    """
    names = ("words", "boxes", "normalized_boxes", "labels")
    n = {c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in names}

    def first(column: str, bad) -> Column:
        """Place, from 0, of the first bad element, null if there is none."""
        at = F.filter(F.transform(F.coalesce(F.col(column), F.array()), lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull())
        at = F.filter(at, lambda i: i < n["words"]) if column != "labels" else at
        return F.try_element_at(at, F.lit(1))

    broken = lambda b: b.isNull() | (F.size(b) != 4) | F.exists(b, lambda v: v.isNull())
    flat = lambda b: broken(b) | (F.get(b, F.lit(2)) <= F.get(b, F.lit(0))) | (F.get(b, F.lit(3)) <= F.get(b, F.lit(1)))
    beyond = lambda b: broken(b) | F.exists(b, lambda v: (v < 0) | (v > 1000))
    told = [("unknown label", "labels", lambda x: x.isNull() | ~x.isin([*labels, "IGNORE"])), ("bad box", "boxes", flat), ("bad normalised box", "normalized_boxes", beyond)]
    sizes = F.array(*[n[c] for c in names])
    errors = [F.when(n["words"] == 0, "no words"), F.when(F.array_max(sizes) != F.array_min(sizes), "unequal lengths")]
    errors += [F.concat(F.lit(f"{what} at "), first(column, bad).cast("string")) for what, column, bad in told]
    return records.withColumn("errors", F.array_compact(F.array(*errors)))


def audit_labels(words: DataFrame, relations: DataFrame, label: str = "label") -> DataFrame:
    """By document of words: how many label an item's name and price, and issues: one without the other, no relations.

    A null label counts as none. Relations are counted before the join, so that each document brings one row.
    """
    has = lambda field: F.count_if(F.contains(F.col(label), F.lit(field)))
    held = words.groupBy("doc_id").agg(has("ITEM_NAME").alias("name_words"), has("ITEM_PRICE").alias("price_words"))
    related = relations.groupBy("doc_id").agg(F.count("*").alias("n_relations"))
    n, p = F.col("name_words"), F.col("price_words")
    issues = [F.when((p > 0) & (n == 0), "price without name"), F.when((n > 0) & (p == 0), "name without price"), F.when(F.col("n_relations") == 0, "no relations")]
    return held.join(related, "doc_id", "left").withColumn("n_relations", F.coalesce("n_relations", F.lit(0).cast("bigint"))).withColumn("issues", F.array_compact(F.array(*issues)))
