"""Head and dependent spans: candidate pairs, edge selection, grouped items, and matches of spans to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillroll.functions import geometry as G
from tillroll.functions import labels as L
from tillroll.functions import schema as S

_SIDE = ("span_id", "field", "text", "line_no", "x0", "y0", "x1", "y1")


def candidate_pairs(spans: DataFrame) -> DataFrame:
    """Every head with every candidate dependent of its document, numbered in order of both.

    The join is on doc_id alone, so both sides keep the layout of the spans; pairs grow with one receipt's spans. Unit
    boxes (u0 to u3, of thousandths of the page) are made once for each span, before it meets others.
    """
    page = Window.partitionBy("doc_id")
    width, height = F.max("page_w").over(page), F.max("page_h").over(page)
    sized = spans.withColumn("pw", width).withColumn("ph", height)
    thousandths = G.normalise_1000([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("pw"), F.col("ph"))
    boxed = sized.withColumn("n", thousandths)
    boxed = boxed.select(*spans.columns, *[v.alias(f"u{k}") for k, v in enumerate(G.to_unit(G.box_of(F.col("n"))))])
    side = lambda p, role: boxed.where(role(F.col("field"))).select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in (*_SIDE, "u0", "u1", "u2", "u3")])
    pairs = side("head", L.is_head).join(side("dep", L.is_candidate_dependent), "doc_id").where("head_span_id <> dep_span_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("head_span_id", "dep_span_id")) - 1
    return pairs.withColumn("pair_index", number)


def geometry_of(pairs: DataFrame) -> DataFrame:
    """Adds the 28 pair features of the unit boxes."""
    unit = lambda p: [F.col(f"{p}_u{k}") for k in range(4)]
    return pairs.select("*", *[v.alias(k) for k, v in G.pair_features(unit("head"), unit("dep")).items()])


def score_by_geometry(pairs: DataFrame) -> DataFrame:
    """Adds prob, a rational stand-in for a pair model: the same row, and the dependent to the right."""
    return geometry_of(pairs).withColumn("prob", F.round(0.6 * F.col("same_row") + 0.2 * F.col("overlap_y") + 0.2 * F.col("right") * (1 - F.col("gap_x")), 6))


def gold_edges(pairs: DataFrame) -> DataFrame:
    """Adds gold: 1 if both spans are on one line and the dependent is a true dependent of the head's kind."""
    item = (F.col("head_field") == "ITEM_NAME") & L.is_item_dependent(F.col("dep_field"))
    total = F.col("head_field").isin(*S.SUMMARY_HEADS) & L.is_dependent(F.col("dep_field")) & ~L.is_item_dependent(F.col("dep_field"))
    return pairs.withColumn("gold", F.when((F.col("head_line_no") == F.col("dep_line_no")) & (item | total), 1).otherwise(0))


def select_edges(pairs: DataFrame, threshold: float = S.THRESHOLD, collisions: str = "best_dep") -> DataFrame:
    """Edges at or over the threshold; with best_dep the likeliest for each dependent, with link_margin to the next."""
    over = pairs.where(F.col("prob") >= threshold)
    if collisions != "best_dep":
        return over.withColumn("link_margin", F.lit(None).cast("double"))
    best = Window.partitionBy("doc_id", "dep_span_id").orderBy(F.desc("prob"), "pair_index")
    return over.withColumn("rank", F.row_number().over(best)).withColumn("link_margin", F.col("prob") - F.lead("prob").over(best)).where("rank = 1").drop("rank")


def decode_items(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each ITEM_NAME span with its slots: the likeliest edge of each single slot, lists of options and extras.

    n_edges counts edges that fill a slot, n_dropped further ones of a filled slot, n_low_margin those with a small
    margin; missing_price says that no price was linked.
    """
    linked = edges.where((F.col("head_field") == "ITEM_NAME") & L.is_item_dependent(F.col("dep_field"))).withColumn("slot", L.output_key(F.col("dep_field")))
    place = Window.partitionBy("doc_id", "head_span_id", "slot").orderBy(F.desc("prob"), "pair_index")
    ranked = linked.withColumn("place", F.row_number().over(place)).withColumn("listed", F.col("slot").isin(*S.LIST_SLOTS))
    single = lambda slot: F.max(F.when((F.col("slot") == slot) & (F.col("place") == 1), F.col("dep_text"))).alias(slot)
    many = lambda slot: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == slot, F.struct("place", "dep_text")))), lambda x: x["dep_text"]), "|").alias(slot)
    slots = ranked.groupBy("doc_id", F.col("head_span_id").alias("span_id")).agg(
        *map(single, ("price", "quantity", "unit_price", "item_code", "item_sku", "discount", "tax_flag")),
        *map(many, S.LIST_SLOTS),
        F.count_if(F.col("listed") | (F.col("place") == 1)).alias("n_edges"),
        F.count_if(~F.col("listed") & (F.col("place") > 1)).alias("n_dropped"),
        F.count_if(F.col("link_margin") < S.LOW_MARGIN).alias("n_low_margin"),
    )
    heads = spans.where("field = 'ITEM_NAME'").select("doc_id", "span_id", F.col("text").alias("item_name"))
    items = heads.join(slots, ["doc_id", "span_id"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("span_id")) - 1
    return items.withColumn("item_index", number).withColumn("missing_price", F.col("price").isNull()).na.fill(0, ["n_edges", "n_dropped", "n_low_margin"]).na.fill("", S.LIST_SLOTS)


def decode_summary(edges: DataFrame) -> DataFrame:
    """doc_id, section, slot, n and text: the dependents linked to heads of sums, likeliest first."""
    keys = F.create_map(*[F.lit(x) for (h, d), v in S.SUMMARY_SLOTS.items() for x in (f"{h}>{d}", ".".join(v))])
    slot = F.element_at(keys, F.concat_ws(">", "head_field", "dep_field"))
    named = edges.withColumn("at", slot).where("at IS NOT NULL")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "pair_index", "dep_text"))), lambda x: x["dep_text"]), "|")
    return named.groupBy("doc_id", F.substring_index("at", ".", 1).alias("section"), F.substring_index("at", ".", -1).alias("slot")).agg(F.count("*").alias("n"), texts.alias("text"))


def match_by_overlap(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Each span with the line that shares most of its words, the first of equal ones; null if none does.

    spans(doc_id, span_id, first_word, last_word), lines(doc_id, line_no, word_idx).
    """
    words = spans.select("doc_id", "span_id", F.explode(F.sequence("first_word", "last_word")).alias("word_idx"))
    shared = words.join(lines, ["doc_id", "word_idx"]).groupBy("doc_id", "span_id", "line_no").agg(F.count("*").alias("overlap"))
    best = Window.partitionBy("doc_id", "span_id").orderBy(F.desc("overlap"), "line_no")
    first = shared.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("doc_id", "span_id", F.col("line_no").alias("match_line"), "overlap")
    return spans.join(first, ["doc_id", "span_id"], "left")


def _tall(p: str = "") -> Column:
    return F.greatest(F.lit(1.0), (F.col(f"{p}y1") - F.col(f"{p}y0")).cast("double"))


def nearest_same_row(heads: DataFrame, candidates: DataFrame, right: bool = False) -> DataFrame:
    """For each head the candidate with the least score on its row; a candidate may serve several heads.

    The row's tolerance is 1.45 times the upper median of the heights of the head and its document's candidates, from 10
    to 90. With right, candidates to the left by more than a fifth of the head's height are left out.
    """
    cx, cy = (lambda p: (F.col(f"{p}x0") + F.col(f"{p}x1")) / 2), (lambda p: (F.col(f"{p}y0") + F.col(f"{p}y1")) / 2)
    other = candidates.select("doc_id", *[F.col(c).alias(f"c_{c}") for c in ("span_id", "text", "x0", "y0", "x1", "y1")])
    tall = other.groupBy("doc_id").agg(F.collect_list(_tall("c_")).alias("_talls"))  # of one receipt
    every = F.array_sort(F.concat(F.array(_tall()), F.col("_talls")))
    reach = F.greatest(F.lit(10.0), F.least(F.lit(90.0), 1.45 * F.element_at(every, F.floor(F.size(every) / 2).cast("int") + 1)))
    placed = heads.join(tall, "doc_id").withColumn("_reach", reach).drop("_talls")
    dx, dy = cx("c_") - cx(""), F.abs(cy("c_") - cy(""))
    joined = placed.join(other, "doc_id").where((dy <= F.col("_reach")) & ((dx >= -0.2 * _tall()) if right else F.lit(True)))
    score = 10 * dy + 0.04 * F.abs(dx) + F.when(dx < 0, 25.0).otherwise(0.0)
    best = Window.partitionBy("doc_id", "span_id").orderBy("score", "c_span_id")
    return joined.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "_reach")


def nearest_exclusive(heads: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, span_id and c_span_id: as nearest_same_row() to the right, but heads take candidates in order and each
    serves once; the median is over the head and the candidates that are left.

    The choice of one head depends on those before it; documents are worked on many at a time, see pages.exclusive().
    """
    from tillroll.operators import pages

    side = lambda df, head: df.select("doc_id", "span_id", F.lit(head).alias("head"), "x0", "y0", "x1", "y1")
    return pages.by_document(side(heads, True).unionByName(side(candidates, False)), pages.exclusive, pages.EXCLUSIVE)


def candidate_spans(spans: DataFrame, vocabulary: list[str] = S.FIELDS) -> DataFrame:
    """Adds new_id, dense over the spans that can be in a pair, in order, and reason, why another is not (else null)."""
    field = L.canonical_field(F.col("field"))
    reason = F.when(L.field_for_vocabulary(F.col("field"), vocabulary).isNull(), "field_not_in_vocab").when(~(L.is_head(field) | L.is_candidate_dependent(field)), "not_relg_candidate")
    marked = spans.withColumn("reason", reason)
    number = F.row_number().over(Window.partitionBy("doc_id", F.col("reason").isNull()).orderBy("span_id")) - 1
    return marked.withColumn("new_id", F.when(F.col("reason").isNull(), number))


def relation_list(documents: DataFrame) -> DataFrame:
    """The relations of documents(doc_id, item_relations, summary_relations, payment_relations, relations, rel_g_edges), one
    row each with its place rel_idx: all of the first three if there are any, else relations, else rel_g_edges."""
    none = lambda c: F.coalesce(F.col(c), F.array())
    own = F.concat(*[none(f"{k}_relations") for k in ("item", "summary", "payment")])
    chosen = F.when(F.size(own) > 0, own).when(F.size(none("relations")) > 0, F.col("relations")).otherwise(none("rel_g_edges"))
    return documents.select("doc_id", F.posexplode(chosen).alias("rel_idx", "relation"))


def group_keys(spans: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds group_key to spans(doc_id, span_id, first_word, last_word): that of the last relation which one of its two
    sides meets the span, null if none does.

    relations(doc_id, rel_idx, group_id, head_field, head_words, dep_field, dep_words). A side meets the span that shares
    most of its words, the first of equal ones; a relation counts if its fields are a head and a dependent and both sides
    meet a span. One without a group_id takes the key that its head's span has by then, else one of its own place; as
    that depends on those before, documents with such relations are folded one by one, all others by aggregates.
    """
    fits = relations.where(L.is_head(L.canonical_field(F.col("head_field"))) & L.is_dependent(L.canonical_field(F.col("dep_field"))))
    words = spans.select("doc_id", "span_id", F.explode(F.sequence("first_word", "last_word")).alias("word"))

    def met(side: str) -> DataFrame:
        wanted = fits.select("doc_id", "rel_idx", F.explode(F.array_distinct(f"{side}_words")).alias("word"))
        shared = wanted.join(words, ["doc_id", "word"]).groupBy("doc_id", "rel_idx", "span_id").agg(F.count("*").alias("n"))
        return shared.groupBy("doc_id", "rel_idx").agg(F.max(F.struct("n", -F.col("span_id"))).alias("best")).select("doc_id", "rel_idx", (-F.col("best")["col2"]).alias(side))

    both = fits.select("doc_id", "rel_idx", "group_id").join(met("head"), ["doc_id", "rel_idx"]).join(met("dep"), ["doc_id", "rel_idx"])
    open_ = both.withColumn("open", F.max(F.col("group_id").isNull()).over(Window.partitionBy("doc_id")))
    sides = open_.where("NOT open").select("doc_id", "rel_idx", "group_id", F.explode(F.array_distinct(F.array("head", "dep"))).alias("span_id"))
    last = sides.groupBy("doc_id", "span_id").agg(F.max_by("group_id", "rel_idx").alias("group_key"))

    def fold(page):
        import pandas as pd

        keys: dict[int, str] = {}
        for r in page.sort_values("rel_idx").itertuples():
            own = r.group_id if isinstance(r.group_id, str) else keys.get(r.head) or f"item_rel_{r.rel_idx:04d}"
            keys[r.head] = keys[r.dep] = own
        return pd.DataFrame({"doc_id": page["doc_id"].iloc[0], "span_id": list(keys), "group_key": list(keys.values())})

    folded = open_.where("open").drop("open").groupBy("doc_id").applyInPandas(fold, "doc_id bigint, span_id int, group_key string")
    return spans.join(last.unionByName(folded), ["doc_id", "span_id"], "left")


def edge_verdicts(pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """Pairs with a status: correct or wrong if they are over the threshold, missed if they are true and are not; and
    hard_negative, wrong to a total or subtotal."""
    over, gold = F.col("prob") >= threshold, F.col("gold") == 1
    status = F.when(over & gold, "correct").when(over, "wrong").when(gold, "missed")
    hard = (F.col("status") == "wrong") & (F.col("dep_field").startswith("TOTAL_") | F.col("dep_field").startswith("SUBTOTAL_"))
    return pairs.withColumn("status", status).where("status IS NOT NULL").withColumn("hard_negative", hard)


def edge_payload(pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """Adds pred, 1 over the threshold, and correct, whether that agrees with gold."""
    over = F.col("prob") >= threshold
    return pairs.withColumn("pred", over.cast("int")).withColumn("correct", over == (F.col("gold") == 1))


def item_errors(spans: DataFrame, pairs: DataFrame, threshold: float = S.THRESHOLD) -> DataFrame:
    """doc_id, kind, span_id and n: names to which no selected edge gives a price, or more than one does; dependents with
    more than one edge over the threshold."""
    priced = select_edges(pairs, threshold).where("head_field = 'ITEM_NAME' AND dep_field = 'ITEM_PRICE'").groupBy("doc_id", F.col("head_span_id").alias("span_id")).agg(F.count("*").alias("n"))
    names = spans.where("field = 'ITEM_NAME'").select("doc_id", "span_id").join(priced, ["doc_id", "span_id"], "left").na.fill(0, ["n"])
    wrong = names.where("n <> 1").select("doc_id", F.when(F.col("n") == 0, "no price").otherwise("several prices").alias("kind"), "span_id", "n")
    shared = pairs.where(F.col("prob") >= threshold).groupBy("doc_id", F.col("dep_span_id").alias("span_id")).agg(F.count("*").alias("n")).where("n > 1")
    return wrong.unionByName(shared.select("doc_id", F.lit("collision").alias("kind"), "span_id", "n"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, zero where nothing can be divided."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]
