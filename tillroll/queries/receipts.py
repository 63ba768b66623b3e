"""Queries over the receipts of plans.fixture: labels, boxes, spans, pairs, decoded items and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions import geometry as G
from tillroll.functions import labels as L
from tillroll.functions import policy as Y
from tillroll.functions import schema as S
from tillroll.functions import text as X
from tillroll.operators import metrics as M
from tillroll.operators import pages as D
from tillroll.operators import pairs as P
from tillroll.operators import preparation as W
from tillroll.operators import spans as B
from tillroll.plans.fixture import LINES_SQL, WORDS_SQL, lines, words
from tillroll.queries._registry import registry
from tillroll.sources import ocr as O

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


query = registry(QUERIES, ORACLE_SQL)


# SQL pieces, written apart from the operators.
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FIELD = "CASE regexp_replace({l}, '^[BI]-', '') " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in [*S.ALIASES.items(), ("menu.nm", "ITEM_NAME")]) + " ELSE regexp_replace({l}, '^[BI]-', '') END"
_field = lambda label: _FIELD.replace("{l}", label)
_WORDS = f"WITH words AS ({WORDS_SQL})"


def _spans_sql(label: str, name: str, extra: str = "FALSE") -> str:
    """Common table expressions that end in a table of spans."""
    return f"""{name}_f AS (SELECT *, {_field(label)} AS field FROM words),
    {name}_s AS (SELECT *, field <> 'O' AND (NOT starts_with({label}, 'I-') OR lag(field) OVER w IS DISTINCT FROM field OR {extra}) AS starts, starts_with({label}, 'I-') AND (lag(field) OVER w IS DISTINCT FROM field OR {extra}) AS orphan
        FROM {name}_f WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)),
    {name}_i AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY word_idx) AS island FROM {name}_s),
    {name}_g AS (SELECT doc_id, island, any_value(field) AS field, min(word_idx) AS first_word, max(word_idx) AS last_word, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_idx) AS raw_text, avg(confidence) AS confidence,
        min(confidence) AS confidence_min, bool_or(orphan) AS orphan, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(page_w) AS page_w, max(page_h) AS page_h, min(line_no) AS line_no FROM {name}_i WHERE field <> 'O' GROUP BY doc_id, island),
    {name} AS (SELECT * EXCLUDE (island), (row_number() OVER (PARTITION BY doc_id ORDER BY first_word) - 1)::INT AS span_id, CASE WHEN field IN ({_list(S.PRICE_FIELDS)}) THEN replace(raw_text, ' ', '') ELSE raw_text END AS text FROM {name}_g)"""


_U = lambda p, c, w: f"greatest(0.0, least(1.0, greatest(0, least(1000, trunc(1000 * {p}{c} / {w})::INT)) / 1000))"
_PAIRS = f"""{_WORDS}, {_spans_sql("pred_label", "spans")},
    pairs_0 AS (SELECT h.doc_id, {", ".join(f"{p[0]}.{c} AS {p}_{c}" for p in ("head", "dep") for c in ("span_id", "field", "text", "line_no", "x0", "y0", "x1", "y1"))}, h.page_w, m.page_h
        FROM spans h JOIN spans d ON h.doc_id = d.doc_id AND h.span_id <> d.span_id JOIN (SELECT doc_id, max(page_h) AS page_h FROM spans GROUP BY doc_id) m ON m.doc_id = h.doc_id
        WHERE h.field IN ({_list(S.HEADS)}) AND d.field IN ({_list(dict.fromkeys([*S.DEPENDENTS, *S.HARD_NEGATIVES]))})),
    pairs_1 AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY head_span_id, dep_span_id) - 1)::INT AS pair_index,
        {", ".join(f"{_U(p + '_', c, 'page_w' if c[0] == 'x' else 'page_h')} AS {p[0]}{c}" for p in ("head", "dep") for c in ("x0", "y0", "x1", "y1"))} FROM pairs_0),
    pairs_2 AS (SELECT *, (dx0 + dx1) / 2 - (hx0 + hx1) / 2 AS dx, (dy0 + dy1) / 2 - (hy0 + hy1) / 2 AS dy, greatest(0.0, greatest(hx0, dx0) - least(hx1, dx1)) AS gap_x, greatest(0.0, greatest(hy0, dy0) - least(hy1, dy1)) AS gap_y,
        greatest(0.0, least(hy1, dy1) - greatest(hy0, dy0)) / greatest(1e-6, least(greatest(0.0, hy1 - hy0), greatest(0.0, dy1 - dy0))) AS overlap_y,
        greatest(0.0, least(hx1, dx1) - greatest(hx0, dx0)) / greatest(1e-6, least(greatest(0.0, hx1 - hx0), greatest(0.0, dx1 - dx0))) AS overlap_x FROM pairs_1),
    pairs_3 AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, 1 / (1 + abs(dy) / greatest(1e-6, ((hy1 - hy0) + (dy1 - dy0)) / 2)) AS same_row, 1 / (1 + abs(dx) / greatest(1e-6, ((hx1 - hx0) + (dx1 - dx0)) / 2)) AS same_col FROM pairs_2),
    scored AS (SELECT *, round(0.6 * same_row + 0.2 * overlap_y + 0.2 * (CASE WHEN dx > 0 THEN 1.0 ELSE 0.0 END) * (1 - gap_x), 6) AS prob,
        CASE WHEN head_line_no = dep_line_no AND ((head_field = 'ITEM_NAME' AND dep_field IN ({_list(S.ITEM_DEPENDENTS)})) OR (head_field IN ({_list(S.SUMMARY_HEADS)}) AND dep_field IN ({_list(x for x in S.DEPENDENTS if x not in S.ITEM_DEPENDENTS)}))) THEN 1 ELSE 0 END AS gold FROM pairs_3)"""
_EDGES = f"""{_PAIRS}, edges_0 AS (SELECT *, row_number() OVER d AS rank, prob - lead(prob) OVER d AS link_margin FROM scored WHERE prob >= {S.THRESHOLD} WINDOW d AS (PARTITION BY doc_id, dep_span_id ORDER BY prob DESC, pair_index)),
    edges AS (SELECT * FROM edges_0 WHERE rank = 1)"""
_PRF = "tp, fp, fn, tp + fn AS support, tp + fp AS predicted, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
_COUNTS = "count_if(prob >= {t} AND gold = 1) AS tp, count_if(prob >= {t} AND gold = 0) AS fp, count_if(prob < {t} AND gold = 1) AS fn"
_T = _COUNTS.replace("{t}", str(S.THRESHOLD))


def _spans(spark: SparkSession, sf_dir: str, label: str = "pred_label") -> DataFrame:
    return B.bio_spans(words(spark, sf_dir), label)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gold_edges(P.score_by_geometry(P.candidate_pairs(_spans(spark, sf_dir))))


def _counted(spark: SparkSession, sf_dir: str, thresholds: list[float]) -> DataFrame:
    """Numbers of scored pairs, made and counted document by document."""
    return _paged(spark, sf_dir, D.tallies("pred_label", thresholds), "pred_label", *D.BOXED)


def _paged(spark: SparkSession, sf_dir: str, made: tuple, *columns: str) -> DataFrame:
    """What is made of the words of whole documents, which plans.fixture keeps together."""
    return D.by_document(words(spark, sf_dir).select("doc_id", "word_idx", *columns), *made, together=True)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


@query(f"{_WORDS} SELECT pred_label, {_field('pred_label')} AS field, CASE WHEN pred_label = 'O' THEN 'O' ELSE substr(pred_label, 1, 2) || ({_field('pred_label')}) END AS label, CASE {_field('pred_label')} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in S.OUTPUT_KEYS.items())} ELSE lower({_field('pred_label')}) END AS key, count(*) AS n FROM words GROUP BY ALL")
def label_canonicalize(spark, sf_dir):
    w, p = words(spark, sf_dir), F.col("pred_label")
    return w.groupBy("pred_label", L.label_field(p).alias("field"), L.canonical_label(p).alias("label"), L.output_key(L.label_field(p)).alias("key")).agg(F.count("*").alias("n"))


@query(f"{_WORDS} SELECT doc_id, word_idx, CASE WHEN {_field('gold_label')} IN ({_list(S.PRICE_FIELDS)}) THEN replace(' ' || text || '  .5 ', ' ', '') ELSE trim(text || '  .5 ') || '' END AS messy FROM words".replace("trim(text || '  .5 ')", "replace(trim(text || '  .5 '), '  ', ' ')"))
def span_text_normalize(spark, sf_dir):
    return words(spark, sf_dir).select("doc_id", "word_idx", L.span_text(L.label_field(F.col("gold_label")), F.concat(F.lit(" "), "text", F.lit("  .5 "))).alias("messy"))


_CL = lambda v, w: f"greatest(0, least({v}, {w} - 1))"


@query(f"""{_WORDS}, s AS (SELECT doc_id, word_idx, page_w, page_h, round_even(least(a, b), 0)::INT AS l, round_even(greatest(a, b), 0)::INT AS r, round_even(y0 - 120.5, 0)::INT AS t, round_even(y1 - 120.5, 0)::INT AS m FROM (SELECT *, x1 * 1.5 AS a, x0 * 1.5 AS b FROM words)),
    c AS (SELECT doc_id, word_idx, page_w, page_h, {_CL("l", "page_w")} AS x0, {_CL("t", "page_h")} AS y0, {_CL("r", "page_w")} AS x1, {_CL("m", "page_h")} AS y1 FROM s)
    SELECT doc_id, word_idx, x0, y0, x1, y1, trunc(1000 * x0 / page_w)::INT AS n0, trunc(1000 * y1 / page_h)::INT AS n3, trunc(1000 * x1 / page_w)::INT / 1000 AS u2 FROM c WHERE x1 > x0 AND y1 > y0""")
def box_clamp_normalize(spark, sf_dir):
    w = words(spark, sf_dir)
    sides = {"left": F.col("x1") * 1.5, "top": F.col("y0") - 120.5, "right": F.col("x0") * 1.5, "bottom": F.col("y1") - 120.5}
    return D.by_document(w.select("doc_id", "word_idx", "page_w", "page_h", *[c.cast("double").alias(n) for n, c in sides.items()]), D.clamped, D.CLAMPED, together=True)


_PAIR_COLUMNS = {"dx": "dx", "dy": "dy", "distance": "distance", "overlap_x": "overlap_x", "overlap_y": "overlap_y", "gap_x": "gap_x", "gap_y": "gap_y", "same_row": "same_row", "same_col": "same_col", "prob": "prob"}


@query(f"{_PAIRS} SELECT doc_id, pair_index, {', '.join(f'round({b}, 6) AS {a}' for a, b in _PAIR_COLUMNS.items())}, round(CASE WHEN distance > 0 THEN dy / distance ELSE 0 END, 6) AS sin, round((dx1 - dx0) * (dy1 - dy0), 6) AS area_j FROM scored")
def pair_geometry(spark, sf_dir):
    cols = [*_PAIR_COLUMNS, "sin", "area_j"]
    return _rounded(_scored(spark, sf_dir), *cols).select("doc_id", "pair_index", *cols)


_SHEAR = "((x0 + x1) / 2.0)"


@query(f"""{_WORDS}, q AS (SELECT doc_id, word_idx, x1 - x0 AS w, y1 - y0 AS h, (word_idx % 7 - 3)::DOUBLE AS s FROM words)
    SELECT doc_id, word_idx, round(degrees(atan2(s, w)), 6) AS angle, round(w * h::DOUBLE, 6) AS area, CASE WHEN degrees(atan2(s, w)) * 30 + 90 >= 0 THEN round((degrees(atan2(s, w)) * 30 + 90) % 180 - 90, 6) ELSE round((degrees(atan2(s, w)) * 30 + 90) % 180 + 90, 6) END AS wrapped FROM q""")
def quad_angle_features(spark, sf_dir):
    w = words(spark, sf_dir)
    s = (F.col("word_idx") % 7 - 3).cast("double")
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), y.alias("y"))
    quad = F.array(corner("x0", F.col("y0") * 1.0), corner("x1", F.col("y0") + s), corner("x1", F.col("y1") + s), corner("x0", F.col("y1") * 1.0))
    made = w.select("doc_id", "word_idx", quad.alias("q")).select("doc_id", "word_idx", G.quad_angle(F.col("q")).alias("a"), G.polygon_area(F.col("q")).alias("area"))
    return made.select("doc_id", "word_idx", F.round("a", 6).alias("angle"), F.round("area", 6).alias("area"), F.round(G.normal_angle(F.col("a") * 30), 6).alias("wrapped"))


_SPAN = "doc_id, span_id, field, first_word, last_word, n_words, text, round(confidence, 6) AS confidence, confidence_min, orphan, x0, y0, x1, y1"


def _span_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "span_id", "field", "first_word", "last_word", "n_words", "text", F.round("confidence", 6).alias("confidence"), "confidence_min", "orphan", "x0", "y0", "x1", "y1")


@query(f"{_WORDS}, {_spans_sql('pred_label', 'spans')} SELECT {_SPAN} FROM spans")
def bio_spans(spark, sf_dir):
    return _span_columns(_spans(spark, sf_dir))


@query(f"{_WORDS}, {_spans_sql('pred_label', 'spans', 'lag(line_no) OVER w IS DISTINCT FROM line_no')} SELECT {_SPAN} FROM spans")
def bio_spans_row_gated(spark, sf_dir):
    return _span_columns(B.bio_spans(words(spark, sf_dir), "pred_label", "line_no"))


@query(f"""{_WORDS}, f AS (SELECT *, {_field('pred_label')} AS field, lag({_field('pred_label')}) OVER w AS before, lag(text) OVER w AS t, lag(line_no) OVER w AS l, lag(x1) OVER w AS r, greatest(1, y1 - y0, lag(y1) OVER w - lag(y0) OVER w) AS h FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx))
    SELECT doc_id, word_idx, CASE WHEN starts_with(pred_label, 'B-') AND field <> 'O' AND before = field AND field NOT IN ({_list([*S.SUMMARY_HEADS, 'PAYMENT_METHOD'])}) AND (field NOT IN ({_list(S.PRICE_FIELDS)}) OR t IN ('$', 'Y', 'EUR', 'GBP', '-', '.')) AND l = line_no AND x0 - r <= 3 * h THEN 'I-' || field ELSE pred_label END AS repaired FROM f""")
def bio_repair(spark, sf_dir):
    return B.repair_bio(words(spark, sf_dir)).select("doc_id", "word_idx", "repaired")


_WITH_FIELD = f"{_WORDS}, f AS (SELECT *, {_field('pred_label')} AS field FROM words)"


@query(f"""{_WITH_FIELD} SELECT doc_id, word_idx, CASE WHEN field = 'O' THEN 'O' WHEN lag(field) OVER w = field AND abs((lag(y0) OVER w + lag(y1) OVER w) / 2 - (y0 + y1) / 2) <= 0.6 * greatest(y1 - y0, lag(y1) OVER w - lag(y0) OVER w) AND x0 - lag(x1) OVER w <= 3 * greatest(y1 - y0, lag(y1) OVER w - lag(y0) OVER w) THEN 'I-' || field ELSE 'B-' || field END AS label
    FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)""")
def bio_assign_adjacent(spark, sf_dir):
    return B.assign_adjacent(words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label")))).select("doc_id", "word_idx", "label")


@query(f"""{_WITH_FIELD} SELECT doc_id, word_idx, CASE WHEN field = 'O' THEN 'O' WHEN abs((lag(y0) OVER w + lag(y1) OVER w) / 2 - (y0 + y1) / 2) <= greatest(8, 0.65 * least(y1 - y0, lag(y1) OVER w - lag(y0) OVER w)) THEN 'I-' || field ELSE 'B-' || field END AS label
    FROM f WINDOW w AS (PARTITION BY doc_id, field ORDER BY word_idx)""")
def bio_assign_last_field(spark, sf_dir):
    return B.assign_by_field(words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label")))).select("doc_id", "word_idx", "label")


@query(f"{_WITH_FIELD} SELECT doc_id, word_idx, CASE WHEN field = 'O' THEN 'O' WHEN lag(field) OVER w = field AND lag(line_no) OVER w = line_no THEN 'I-' || field ELSE 'B-' || field END AS label FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)")
def bio_recompute(spark, sf_dir):
    return B.recompute_bio(words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label")))).select("doc_id", "word_idx", "label")


@query(None)
def row_clustering(spark, sf_dir):
    return B.row_clusters(words(spark, sf_dir), together=True)


@query(f"""{_WITH_FIELD}, s AS (SELECT *, sum(CASE WHEN lag(field) OVER w IS DISTINCT FROM field AND row_number() OVER w > 1 THEN 1 ELSE 0 END) OVER w AS segment FROM (SELECT *, lag(field) OVER w AS b, row_number() OVER w AS r FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)) WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx))
    SELECT doc_id, word_idx, segment::BIGINT AS segment, (row_number() OVER (PARTITION BY doc_id, segment ORDER BY word_idx) + 1)::INT AS position FROM s""".replace("sum(CASE WHEN lag(field) OVER w IS DISTINCT FROM field AND row_number() OVER w > 1 THEN 1 ELSE 0 END)", "sum(CASE WHEN b IS DISTINCT FROM field AND r > 1 THEN 1 ELSE 0 END)"))
def segment_positions(spark, sf_dir):
    return B.segments(words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label"))), "field").select("doc_id", "word_idx", "segment", "position")


@query(f"{_WORDS} SELECT doc_id, word_idx, ((row_number() OVER w - 1) // 10)::BIGINT AS chunk, ((row_number() OVER w - 1) % 10)::INT AS place FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)")
def token_chunks(spark, sf_dir):
    return B.chunks(words(spark, sf_dir), 10).select("doc_id", "word_idx", "chunk", "place")


@query(f"""{_WORDS}, {_spans_sql('pred_label', 'spans')}, n AS (SELECT doc_id, 'SPAN' AS kind, span_id AS place, field, text FROM spans UNION ALL SELECT doc_id, 'TOKEN', word_idx, 'CONTEXT_TOKEN', text FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND w.word_idx BETWEEN s.first_word AND s.last_word))
    SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY kind, place) - 1)::INT AS node_id FROM n""")
def context_nodes(spark, sf_dir):
    return _paged(spark, sf_dir, D.nodes("pred_label"), "pred_label", "text")


@query(f"{_PAIRS} SELECT doc_id, pair_index, head_span_id, dep_span_id, head_field, dep_field, head_text, dep_text, gold FROM scored")
def candidate_pairs(spark, sf_dir):
    return _paged(spark, sf_dir, D.candidates("pred_label"), "pred_label", "text", *D.BOXED)


@query(f"""{_WORDS}, {_spans_sql('pred_label', 'spans')}, o AS (SELECT s.doc_id, span_id, w.line_no, count(*) AS overlap FROM spans s JOIN words w ON s.doc_id = w.doc_id AND w.word_idx BETWEEN first_word AND last_word GROUP BY ALL),
    b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY overlap DESC, line_no) = 1) SELECT s.doc_id, s.span_id, b.line_no AS match_line, overlap FROM spans s LEFT JOIN b USING (doc_id, span_id)""")
def span_gold_match(spark, sf_dir):
    w = words(spark, sf_dir)
    return P.match_by_overlap(B.bio_spans(w, "pred_label"), w.select("doc_id", "line_no", "word_idx")).select("doc_id", "span_id", "match_line", "overlap")


def _near_sql(dep: str, right: bool) -> str:
    return f"""{_WORDS}, {_spans_sql('gold_label', 'spans')}, s AS (SELECT *, greatest(1.0, y1 - y0) AS tall, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM spans), t AS (SELECT doc_id, list(tall) AS talls FROM s WHERE field = '{dep}' GROUP BY doc_id),
    h AS (SELECT s.*, greatest(10.0, least(90.0, 1.45 * list_sort(list_append(talls, tall))[(len(talls) + 1) // 2 + 1])) AS reach FROM s JOIN t ON s.doc_id = t.doc_id WHERE field = 'ITEM_NAME'),
    j AS (SELECT h.doc_id, h.span_id, h.tall, h.reach, c.span_id AS c_span_id, c.text AS c_text, c.cx - h.cx AS dx, abs(c.cy - h.cy) AS dy FROM h JOIN s c ON h.doc_id = c.doc_id AND c.field = '{dep}'),
    p AS (SELECT *, 10 * dy + 0.04 * abs(dx) + CASE WHEN dx < 0 THEN 25 ELSE 0 END AS score FROM j WHERE dy <= reach{" AND dx >= -0.2 * tall" if right else ""})
    SELECT doc_id, span_id, c_span_id, c_text, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY score, c_span_id) = 1"""


def _near(spark, sf_dir, dep, right):
    s = _spans(spark, sf_dir, "gold_label")
    return P.nearest_same_row(s.where("field = 'ITEM_NAME'"), s.where(F.col("field") == dep), right).select("doc_id", "span_id", "c_span_id", "c_text", F.round("score", 6).alias("score"))


@query(_near_sql("ITEM_PRICE", True))
def nearest_same_row(spark, sf_dir):
    return _near(spark, sf_dir, "ITEM_PRICE", True)


@query(_near_sql("ITEM_QTY", False))
def nearest_quantity(spark, sf_dir):
    return _near(spark, sf_dir, "ITEM_QTY", False)


@query(None)
def nearest_same_row_exclusive(spark, sf_dir):
    return _paged(spark, sf_dir, D.label_exclusive("gold_label", "ITEM_NAME", "ITEM_PRICE"), "gold_label", "x0", "y0", "x1", "y1")


@query(f"{_EDGES} SELECT doc_id, pair_index, head_span_id, dep_span_id, prob, round(link_margin, 6) AS link_margin FROM edges")
def edge_select_best_dep(spark, sf_dir):
    return P.select_edges(_scored(spark, sf_dir)).select("doc_id", "pair_index", "head_span_id", "dep_span_id", "prob", F.round("link_margin", 6).alias("link_margin"))


_SINGLE = ("price", "quantity", "unit_price", "item_code", "item_sku", "discount", "tax_flag")
_KEY = f"CASE dep_field {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in S.OUTPUT_KEYS.items())} ELSE lower(dep_field) END"


@query(f"""{_EDGES}, linked AS (SELECT *, {_KEY} AS slot FROM edges WHERE head_field = 'ITEM_NAME' AND dep_field IN ({_list(S.ITEM_DEPENDENTS)})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head_span_id, slot ORDER BY prob DESC, pair_index) AS place FROM linked),
    slots AS (SELECT doc_id, head_span_id AS span_id, {", ".join(f"max(CASE WHEN slot = '{s}' AND place = 1 THEN dep_text END) AS {s}" for s in _SINGLE)}, {", ".join(f"string_agg(dep_text, '|' ORDER BY place) FILTER (slot = '{s}') AS {s}" for s in S.LIST_SLOTS)},
        count_if(slot IN ({_list(S.LIST_SLOTS)}) OR place = 1) AS n_edges, count_if(slot NOT IN ({_list(S.LIST_SLOTS)}) AND place > 1) AS n_dropped, count_if(link_margin < {S.LOW_MARGIN}) AS n_low_margin FROM ranked GROUP BY ALL)
    SELECT h.doc_id, h.span_id, h.text AS item_name, {", ".join(_SINGLE)}, {", ".join(f"coalesce({s}, '') AS {s}" for s in S.LIST_SLOTS)}, coalesce(n_edges, 0) AS n_edges, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_low_margin, 0) AS n_low_margin,
        (row_number() OVER (PARTITION BY h.doc_id ORDER BY h.span_id) - 1)::INT AS item_index, price IS NULL AS missing_price FROM spans h LEFT JOIN slots USING (doc_id, span_id) WHERE h.field = 'ITEM_NAME'""")
def decode_items(spark, sf_dir):
    return _paged(spark, sf_dir, D.decoded("pred_label"), "pred_label", "text", *D.BOXED)


@query(f"""{_EDGES}, slotted AS (SELECT *, CASE {" ".join(f"WHEN head_field = '{h}' AND dep_field = '{d}' THEN '{a}.{b}'" for (h, d), (a, b) in S.SUMMARY_SLOTS.items())} END AS slot_at FROM edges)
    SELECT doc_id, split_part(slot_at, '.', 1) AS section, split_part(slot_at, '.', 2) AS slot, count(*) AS n, string_agg(dep_text, '|' ORDER BY prob DESC, pair_index) AS text FROM slotted WHERE slot_at IS NOT NULL GROUP BY ALL""")
def decode_summary(spark, sf_dir):
    return P.decode_summary(P.select_edges(_scored(spark, sf_dir)))


_R = ("precision", "recall", "f1")
_ROUND = _PRF.replace(" AS precision", "@p").replace(" AS recall", "@r").replace(" AS f1", "@f")
_ROUND = ", ".join((f"round({x.strip()[:-2]}, 6) AS " + {"p": "precision", "r": "recall", "f": "f1"}[x[-1]]) if x[-2] == "@" else x for x in (y for y in _ROUND.replace(", 0), 0)", ",0),0)").split(", ")))


@query(f"{_PAIRS}, c AS (SELECT {_T} FROM scored) SELECT {_ROUND} FROM c")
def edge_metrics(spark, sf_dir):
    return _rounded(M.edge_metrics(_scored(spark, sf_dir)), *_R)


@query(f"{_PAIRS}, c AS (SELECT dep_field, {_T} FROM scored GROUP BY dep_field) SELECT dep_field, {_ROUND} FROM c")
def field_edge_metrics(spark, sf_dir):
    return _rounded(M.edge_metrics(_scored(spark, sf_dir), S.THRESHOLD, "dep_field"), *_R)


@query(f"{_PAIRS}, d AS (SELECT doc_id, head_span_id, dep_span_id, max(prob) AS prob, max(gold) AS gold FROM scored WHERE dep_field = 'ITEM_PRICE' GROUP BY ALL), c AS (SELECT {_T} FROM d) SELECT {_ROUND} FROM c")
def item_price_pair_metrics(spark, sf_dir):
    return _rounded(M.item_price_metrics(_scored(spark, sf_dir)), *_R)


_HARD = f"dep_field IN ({_list(['O', *S.DOCUMENT_FIELDS, *S.SUMMARY_FIELDS, *S.PAYMENT_FIELDS])})"
_HARD_KINDS = {
    "store": "starts_with(dep_field, 'STORE_')",
    "total_subtotal": "starts_with(dep_field, 'TOTAL_') OR starts_with(dep_field, 'SUBTOTAL_') OR dep_field = 'TAX_PRICE'",
    "tax": "starts_with(dep_field, 'TAX_')",
    "summary": "regexp_matches(dep_field, '^(TOTAL|SUBTOTAL|DISCOUNT|SERVICE|TIP)_')",
    "payment": "regexp_matches(dep_field, '^(PAYMENT|CARD|CASH|CHANGE)_')",
    "item": "head_field = 'ITEM_NAME'",
    "wrong_price": "head_field = 'ITEM_NAME' AND dep_field IN ('TOTAL_PRICE', 'SUBTOTAL_PRICE', 'TAX_PRICE', 'TIP_PRICE', 'PAYMENT_INFO')",
}


@query(f"""{_PAIRS}, w AS (SELECT * FROM scored WHERE gold = 0 AND prob >= 0.3 AND {_HARD})
    SELECT head_field, dep_field, grouping(head_field, dep_field)::INT AS level, count(*) AS n, {", ".join(f"count_if({c}) AS n_{k}" for k, c in _HARD_KINDS.items())} FROM w GROUP BY GROUPING SETS ((head_field, dep_field), (dep_field), (head_field), ())""")
def hard_negative_breakdown(spark, sf_dir):
    return M.hard_negatives(_scored(spark, sf_dir), 0.3)


@query(f"{_PAIRS}, d AS (SELECT count(*) AS n FROM scored WHERE prob >= 0.3 GROUP BY doc_id, dep_span_id) SELECT coalesce(sum(n - 1), 0)::BIGINT AS collisions, count_if(n > 1) AS dependents FROM d")
def dependent_collisions(spark, sf_dir):
    return M.dependent_collisions(_scored(spark, sf_dir), 0.3)


_MEASURES = lambda p, tp, fp, fn: f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS {p}_precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS {p}_recall, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS {p}_f1"


def _sweep_sql(thresholds: list[float]) -> str:
    tally = _COUNTS.replace("{t}", "threshold")
    return f"""{_PAIRS}, t AS (SELECT unnest([{", ".join(map(str, thresholds))}])::DOUBLE AS threshold), e AS (SELECT threshold, {tally}, count_if(gold = 0 AND prob >= threshold AND {_HARD}) AS hard FROM scored, t GROUP BY threshold),
    d AS (SELECT doc_id, head_span_id, dep_span_id, max(prob) AS prob, max(gold) AS gold FROM scored WHERE dep_field = 'ITEM_PRICE' GROUP BY ALL), p AS (SELECT threshold, {tally} FROM d, t GROUP BY threshold),
    k AS (SELECT threshold, sum(n - 1)::BIGINT AS collisions FROM (SELECT threshold, doc_id, dep_span_id, count(*) AS n FROM scored, t WHERE prob >= threshold GROUP BY ALL) GROUP BY threshold),
    swept AS (SELECT t.threshold, {_MEASURES("edge", "e.tp", "e.fp", "e.fn")}, {_MEASURES("pair", "p.tp", "p.fp", "p.fn")}, hard AS hard_negatives, coalesce(collisions, 0) AS collisions FROM t JOIN e USING (threshold) JOIN p USING (threshold) LEFT JOIN k USING (threshold))"""


_SWEPT = [f"{a}_{b}" for a in ("edge", "pair") for b in ("precision", "recall", "f1")]


@query(f"{_sweep_sql(M.THRESHOLDS)} SELECT * FROM swept")
def threshold_sweep(spark, sf_dir):
    return _rounded(M.threshold_sweep(_counted(spark, sf_dir, M.THRESHOLDS), counted=True), *_SWEPT)


@query(f"{_sweep_sql(M.THRESHOLDS)} SELECT * FROM swept ORDER BY pair_f1 DESC, pair_precision DESC, hard_negatives, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return _rounded(M.best_threshold(_counted(spark, sf_dir, M.THRESHOLDS), counted=True), *_SWEPT)


@query(f"""{_sweep_sql([0.3])}, s AS (SELECT {_COUNTS.replace("{t}", "0.3")} FROM scored WHERE dep_field IN ({_list(S.SUMMARY_DEPENDENTS)})),
    h AS (SELECT {", ".join(f"count_if({c}) AS hard_{k}" for k, c in _HARD_KINDS.items())} FROM scored WHERE gold = 0 AND prob >= 0.3 AND {_HARD}), n AS (SELECT count(*) AS n_pairs, count_if(gold = 1) AS n_positive FROM scored)
    SELECT swept.*, n.*, h.*, {_MEASURES("summary", "tp", "fp", "fn")} FROM swept, s, h, n""")
def evaluation_summary(spark, sf_dir):
    return _rounded(M.evaluation(_counted(spark, sf_dir, [0.3]), 0.3, counted=True), *_SWEPT, "summary_precision", "summary_recall", "summary_f1")


@query(f"""{_PAIRS} SELECT doc_id, pair_index, CASE WHEN prob >= {S.THRESHOLD} THEN CASE WHEN gold = 1 THEN 'correct' ELSE 'wrong' END ELSE 'missed' END AS status, prob >= {S.THRESHOLD} AND gold = 0 AND regexp_matches(dep_field, '^(TOTAL|SUBTOTAL)_') AS hard_negative
    FROM scored WHERE prob >= {S.THRESHOLD} OR gold = 1""")
def edge_verdicts(spark, sf_dir):
    return _paged(spark, sf_dir, D.verdicts("pred_label"), "pred_label", *D.BOXED)


@query(f"""{_EDGES}, q AS (SELECT doc_id, head_span_id AS span_id, count(*) AS n FROM edges WHERE head_field = 'ITEM_NAME' AND dep_field = 'ITEM_PRICE' GROUP BY ALL), m AS (SELECT s.doc_id, s.span_id, coalesce(n, 0) AS n FROM spans s LEFT JOIN q ON s.doc_id = q.doc_id AND s.span_id = q.span_id WHERE field = 'ITEM_NAME')
    SELECT doc_id, CASE WHEN n = 0 THEN 'no price' ELSE 'several prices' END AS kind, span_id, n FROM m WHERE n <> 1 UNION ALL SELECT doc_id, 'collision', dep_span_id, count(*) FROM scored WHERE prob >= {S.THRESHOLD} GROUP BY doc_id, dep_span_id HAVING count(*) > 1""")
def item_errors(spark, sf_dir):
    return P.item_errors(_spans(spark, sf_dir), _scored(spark, sf_dir))


_RELATED = [*S.HEADS, *dict.fromkeys([*S.DEPENDENTS, *S.HARD_NEGATIVES])]


@query(f"""{_WORDS}, {_spans_sql('pred_label', 'spans')}, m AS (SELECT doc_id, span_id, CASE WHEN field NOT IN ({_list(S.FIELDS)}) THEN 'field_not_in_vocab' WHEN field NOT IN ({_list(_RELATED)}) THEN 'not_relg_candidate' END AS reason FROM spans)
    SELECT doc_id, span_id, reason, CASE WHEN reason IS NULL THEN (row_number() OVER (PARTITION BY doc_id, reason IS NULL ORDER BY span_id) - 1)::INT END AS new_id FROM m""")
def candidate_span_filter(spark, sf_dir):
    return P.candidate_spans(_spans(spark, sf_dir)).select("doc_id", "span_id", "reason", "new_id")


@query(f"""{_WORDS}, {_spans_sql('pred_label', 'spans')}, {_spans_sql('gold_label', 'gold')}, o AS (SELECT p.doc_id, p.span_id, p.field, g.span_id AS gold_id, g.field AS gold_field, least(p.last_word, g.last_word) - greatest(p.first_word, g.first_word) + 1 AS n FROM spans p JOIN gold g ON p.doc_id = g.doc_id AND p.first_word <= g.last_word AND g.first_word <= p.last_word),
    b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, span_id ORDER BY n DESC, gold_id) = 1), f AS (SELECT s.field, count(*) AS pred, count_if(gold_field = s.field) AS correct, count(DISTINCT CASE WHEN gold_field = s.field THEN (s.doc_id, gold_id) END) AS matched FROM spans s LEFT JOIN b USING (doc_id, span_id) GROUP BY s.field),
    h AS (SELECT field, count(*) AS gold FROM gold GROUP BY field), x AS (SELECT field, coalesce(pred, 0) AS pred, coalesce(gold, 0) AS gold, coalesce(correct, 0) AS correct, coalesce(matched, 0) AS matched FROM f FULL JOIN h USING (field))
    SELECT *, round(coalesce(correct / nullif(pred, 0), 0), 6) AS precision, round(coalesce(matched / nullif(gold, 0), 0), 6) AS recall FROM x""")
def span_match_metrics(spark, sf_dir):
    counts = _paged(spark, sf_dir, D.matches("gold_label", "pred_label"), "gold_label", "pred_label")
    return _rounded(M.matched_span_ratios(counts), "precision", "recall")


# Relations of each line, written before and after each other: its name with its quantity, then with its price, under one
# key, and in every third line also the name with the price of the line before, under another.
_RELATIONS = """SELECT doc_id, CAST(3 * line_no + k AS INT) AS rel_idx, CASE k WHEN 2 THEN 'next_' ELSE 'line_' END || line_no AS group_id, 5 * line_no - 4 AS h0, 5 * line_no - 3 AS h1,
    CASE k WHEN 0 THEN 5 * line_no - 2 WHEN 1 THEN 5 * line_no - 1 ELSE 5 * line_no - 6 END AS d0, CASE k WHEN 0 THEN 5 * line_no - 2 WHEN 1 THEN 5 * line_no ELSE 5 * line_no - 5 END AS d1, CASE k WHEN 0 THEN 'ITEM_QTY' ELSE 'MENU_PRICE' END AS dep_field
    FROM {lines} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) WHERE k < 2 OR (line_no % 3 = 0)"""


@query(f"""{_WORDS}, {_spans_sql('pred_label', 'spans')}, r AS ({_RELATIONS.format(lines=f"({LINES_SQL})")}),
    m AS (SELECT r.doc_id, rel_idx, group_id, span_id, side FROM (SELECT *, 'h' AS side, h0 AS a, h1 AS b FROM r UNION ALL SELECT *, 'd', d0, d1 FROM r) r JOIN spans s ON r.doc_id = s.doc_id AND first_word <= b AND a <= last_word
        QUALIFY row_number() OVER (PARTITION BY r.doc_id, rel_idx, side ORDER BY least(b, last_word) - greatest(a, first_word) DESC, span_id) = 1),
    w AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, rel_idx) = 2), g AS (SELECT doc_id, span_id, arg_max(group_id, rel_idx) AS group_key FROM w GROUP BY ALL)
    SELECT s.doc_id, s.span_id, s.field, group_key FROM spans s LEFT JOIN g ON s.doc_id = g.doc_id AND s.span_id = g.span_id""")
def group_keys(spark, sf_dir):
    made = spark.sql(_RELATIONS.replace("{lines}", "{l}"), l=lines(spark, sf_dir))
    sides = made.select("doc_id", "rel_idx", "group_id", F.lit("ITEM_NAME").alias("head_field"), F.array("h0", "h1").alias("head_words"), "dep_field", F.array("d0", "d1").alias("dep_words"))
    return P.group_keys(_spans(spark, sf_dir), sides).select("doc_id", "span_id", "field", "group_key")


@query(f"""{_WORDS}, {_spans_sql('gold_label', 'gold')}, {_spans_sql('pred_label', 'pred')}, j AS (SELECT coalesce(g.field, p.field) AS field, g.field AS gf, p.field AS pf FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.field = p.field AND g.first_word = p.first_word AND g.last_word = p.last_word),
    c AS (SELECT field, count_if(gf IS NOT NULL AND pf IS NOT NULL) AS tp, count_if(gf IS NULL) AS fp, count_if(pf IS NULL) AS fn FROM j GROUP BY field) SELECT field, {_ROUND} FROM c""")
def span_prf_strict(spark, sf_dir):
    w = words(spark, sf_dir)
    return _rounded(M.strict_span_metrics(B.bio_spans(w, "gold_label"), B.bio_spans(w, "pred_label")), *_R)


@query(None)
def span_prf_relaxed(spark, sf_dir):
    counts = _paged(spark, sf_dir, D.label_overlaps("gold_label", "pred_label"), "gold_label", "pred_label")
    return _rounded(M.relaxed_of(counts), *_R)


@query(f"""{_WORDS}, f AS (SELECT {_field('gold_label')} AS g, {_field('pred_label')} AS p FROM words), x AS (SELECT unnest(list_distinct([g, p])) AS field, g, p FROM f),
    c AS (SELECT field, count_if(g = p) AS tp, count_if(g <> field) AS fp, count_if(p <> field) AS fn FROM x WHERE field <> 'O' GROUP BY field) SELECT field, {_ROUND} FROM c""")
def token_field_metrics(spark, sf_dir):
    return _rounded(M.token_field_metrics(words(spark, sf_dir), "gold_label", "pred_label"), *_R)


@query(f"{_WORDS}, c AS (SELECT gold_label AS gold, pred_label AS pred, count(*) AS n FROM words GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 50) SELECT * FROM c WHERE gold <> pred")
def label_confusion_topk(spark, sf_dir):
    return M.label_confusions(words(spark, sf_dir), "gold_label", "pred_label")


@query(f"{_WORDS} SELECT substr(gold_label, 3) AS field, count_if(gold_label LIKE 'B-%' AND pred_label LIKE 'I-%') AS b_as_i, count_if(gold_label LIKE 'I-%' AND pred_label LIKE 'B-%') AS i_as_b, count(*) AS n FROM words WHERE gold_label <> 'O' AND substr(pred_label, 3) = substr(gold_label, 3) GROUP BY ALL")
def boundary_errors(spark, sf_dir):
    return M.boundary_errors(words(spark, sf_dir), "gold_label", "pred_label")


@query(f"""{_WORDS}, f AS (SELECT *, regexp_replace(pred_label, '^[BI]-', '') AS field FROM words) SELECT doc_id, word_idx, pred_label FROM f QUALIFY starts_with(pred_label, 'I-') AND (lag(field) OVER w IS DISTINCT FROM field OR lag(line_no) OVER w IS DISTINCT FROM line_no) WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)""".replace("FROM f QUALIFY starts_with(pred_label, 'I-') AND (lag(field) OVER w IS DISTINCT FROM field OR lag(line_no) OVER w IS DISTINCT FROM line_no) WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)", "FROM (SELECT *, lag(field) OVER w AS bf, lag(line_no) OVER w AS bl FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)) WHERE starts_with(pred_label, 'I-') AND (bf IS DISTINCT FROM field OR bl IS DISTINCT FROM line_no)"))
def bio_grammar_violations(spark, sf_dir):
    return B.bio_violations(words(spark, sf_dir), "pred_label", "line_no").select("doc_id", "word_idx", "pred_label")


@query(f"""WITH lines AS ({LINES_SQL}), m AS (SELECT unnest(['a', 'b', 'c']) AS model), t AS (SELECT doc_id, line_no, model, lpad(((cents - cents % 100) / 100)::BIGINT::VARCHAR, 5, '0') || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS truth FROM lines, m),
    f AS (SELECT *, CASE model WHEN 'a' THEN replace(truth, '0', 'O') WHEN 'b' THEN replace(truth, '.', ',') ELSE replace(truth, '1', '') END AS found FROM t)
    SELECT model, doc_id, line_no, levenshtein(truth, found) AS distance, round(levenshtein(truth, found) / length(truth), 6) AS cer, round(greatest(0, 1 - levenshtein(truth, found) / greatest(length(truth), length(found), 1)), 6) AS char_accuracy, truth = found AS exact, regexp_replace(truth, '[^0-9]', '', 'g') = regexp_replace(found, '[^0-9]', '', 'g') AS digits_match,
        (abs((length(truth) - length(replace(truth, '.', ''))) - (length(found) - length(replace(found, '.', '')))) + abs((length(truth) - length(replace(truth, ',', ''))) - (length(found) - length(replace(found, ',', '')))))::INT AS punctuation FROM f""")
def ocr_token_compare(spark, sf_dir):
    return _rounded(_compared(spark, sf_dir), "cer", "char_accuracy").select("model", "doc_id", "line_no", F.col("distance").cast("bigint").alias("distance"), "cer", "char_accuracy", "exact", "digits_match", "punctuation")


def _compared(spark, sf_dir):
    whole = F.lpad(((F.col("cents") - F.col("cents") % 100) / 100).cast("bigint").cast("string"), 5, "0")
    t = lines(spark, sf_dir).withColumn("truth", F.concat(whole, F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))).withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    found = F.when(F.col("model") == "a", F.translate("truth", "0", "O")).when(F.col("model") == "b", F.translate("truth", ".", ",")).otherwise(F.translate("truth", "1", ""))
    return M.compare_tokens(t.withColumn("found", found))


_FOUND = ORACLE_SQL["ocr_token_compare"].partition("SELECT model, doc_id")[0]


@query(f"""{_FOUND}, c AS (SELECT model, levenshtein(truth, found) / length(truth) AS cer, greatest(0, 1 - levenshtein(truth, found) / greatest(length(truth), length(found), 1)) AS acc, (truth = found)::INT AS exact, (regexp_replace(truth, '[^0-9]', '', 'g') = regexp_replace(found, '[^0-9]', '', 'g'))::INT AS dm FROM f)
    SELECT model, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(acc), 6) AS char_accuracy, round(avg(exact), 6) AS exact_rate, round(avg(cer), 6) AS numeric_cer, round(avg(dm), 6) AS digit_rate FROM c GROUP BY model""")
def ocr_model_summary(spark, sf_dir):
    return _rounded(M.summarise_models(_compared(spark, sf_dir)), "cer", "char_accuracy", "exact_rate", "numeric_cer", "digit_rate")


_CONF = [f"{a}>{b}" for x, y in X.CONFUSIONS for a, b in ((x, y), (y, x))]


@query(f"{_FOUND}, e AS (SELECT model, substr(truth, i, 1) || '>' || substr(found, i, 1) AS pair FROM f, unnest(generate_series(1, length(truth))) AS x(i)) SELECT model, pair, count(*) AS n FROM e WHERE pair IN ({_list(_CONF)}) GROUP BY ALL")
def ocr_confusions(spark, sf_dir):
    return M.character_confusions(_compared(spark, sf_dir))


@query(f"""{_WORDS} SELECT text, count(*) AS n, regexp_matches(text, '^-?[0-9]{{1,6}}[.][0-9][0-9]$') AS price, regexp_matches(text, '^[0-9]{{1,3}}X$') AS quantity, regexp_matches(text, '^[0-9]{{4,}}$') AS strong_code FROM words GROUP BY ALL""")
def item_policy_texts(spark, sf_dir):
    t = F.col("text")
    return words(spark, sf_dir).groupBy("text").agg(F.count("*").alias("n")).select("text", "n", Y.is_kind(t, "price").alias("price"), Y.is_kind(t, "quantity").alias("quantity"), Y.is_kind(t, "strong code").alias("strong_code"))


# Items with texts of blanks, boxes without a size, and boxes beside the page.
_ITEMS = """SELECT doc_id, word_idx AS raw_index, CASE WHEN word_idx % 11 = 3 THEN '  ' WHEN word_idx % 11 = 4 THEN ' ' || text || ' ' ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 2000 ELSE page_w END AS page_w, page_h,
    CAST(x0 + CASE word_idx % 13 WHEN 5 THEN 900 WHEN 6 THEN -700 ELSE 0 END AS DOUBLE) AS a, CAST(y0 AS DOUBLE) AS b, CAST(x1 + CASE word_idx % 13 WHEN 5 THEN 900 ELSE 0 END AS DOUBLE) AS c, CAST(CASE WHEN word_idx % 13 = 7 THEN y0 ELSE y1 END AS DOUBLE) AS d FROM """
_PREPARED = f"""{_WORDS}, i AS ({_ITEMS} words), x AS (SELECT *, least(greatest(round_even(a, 0)::INT, 0), page_w - 1) AS l, least(greatest(round_even(b, 0)::INT, 0), page_h - 1) AS t, least(greatest(round_even(c, 0)::INT, 0), page_w - 1) AS r, least(greatest(round_even(d, 0)::INT, 0), page_h - 1) AS m FROM i),
    s AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN NOT (c > a AND d > b) THEN 'invalid_box' WHEN NOT (r > l AND m > t) THEN 'invalid_box_after_clamp' END AS skipped FROM x)"""


def _items(spark, sf_dir):
    made = spark.sql(_ITEMS + "{w}", w=words(spark, sf_dir))
    return made.withColumn("box", F.array("a", "b", "c", "d")).drop("a", "b", "c", "d")


@query(f"""{_PREPARED} SELECT doc_id, raw_index, trim(text) AS text, skipped, CASE WHEN skipped IS NULL THEN (row_number() OVER (PARTITION BY doc_id, skipped IS NULL ORDER BY raw_index) - 1)::INT END AS word_idx,
    CASE WHEN skipped IS NULL THEN concat_ws(',', l, t, r, m) END AS pixel, CASE WHEN skipped IS NULL THEN concat_ws(',', 1000 * l // page_w, 1000 * t // page_h, 1000 * r // page_w, 1000 * m // page_h) END AS thousandth FROM s""")
def prepared_words(spark, sf_dir):
    made = W.prepare_words(_items(spark, sf_dir))
    joined = lambda c: F.when(F.col("skipped").isNull(), F.array_join(F.transform(c, lambda v: v.cast("string")), ",")).alias(c)
    return made.select("doc_id", "raw_index", "text", "skipped", "word_idx", joined("pixel"), joined("thousandth"))


_BOXED = "(skipped IS NULL OR skipped = 'invalid_box_after_clamp')"


@query(f"""{_PREPARED} SELECT doc_id, count(*) AS n_items, count_if(skipped IS NULL) AS n_words, count_if(skipped = 'empty_text') AS n_empty, count_if(skipped LIKE 'invalid%') AS n_invalid, count_if({_BOXED} AND (c > page_w OR d > page_h)) > greatest(2, count_if({_BOXED}) // 2) AS many_outside,
    coalesce(max(CASE WHEN {_BOXED} THEN greatest(a, b, c, d) END) <= 1000 AND greatest(max(page_w), max(page_h)) > 1500, false) AS maybe_thousandths FROM s GROUP BY doc_id""")
def skipped_words(spark, sf_dir):
    return W.skip_counts(W.prepare_words(_items(spark, sf_dir)))


@query(f"{_WORDS} SELECT doc_id, word_idx, text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM words")
def page_words(spark, sf_dir):
    """Pages of four shapes, written as JSON and read as any page is: a list, words, tokens with values, lines and blocks."""
    w = words(spark, sf_dir)
    made = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "x0", "y0", "x1", "y1"))).alias("held"))
    corner = lambda x: [x[c] for c in ("x0", "y0", "x1", "y1")]
    boxes = F.transform("held", lambda x: F.struct(x["text"].alias("text"), F.array(*corner(x)).alias("box")))
    quads = F.transform("held", lambda x: F.struct(x["text"].alias("value"), F.array(*[x[c] for c in ("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")]).alias("quad")))
    named = F.transform("held", lambda x: F.struct(x["text"].alias("text"), *[c.alias(n) for n, c in zip(("left", "top", "right", "bottom"), corner(x))]))
    shape = F.col("doc_id") % 4
    page = F.when(shape == 0, F.to_json(boxes)).when(shape == 1, F.to_json(F.struct(boxes.alias("words")))).when(shape == 2, F.to_json(F.struct(quads.alias("tokens"))))
    page = page.otherwise(F.to_json(F.struct(F.slice(named, 1, 2).alias("lines"), F.slice(named, 3, 1_000_000).alias("blocks"))))
    read = O.words_of_pages(made.select("doc_id", F.parse_json(page).alias("page")))
    return read.select("doc_id", "word_idx", "text", *[F.col("box")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
