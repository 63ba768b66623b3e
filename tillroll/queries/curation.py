"""Queries that curate the receipts of plans.fixture: policy, relations, categories and record checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import geometry as G
from tillroll.functions import labels as L
from tillroll.operators import curation as C
from tillroll.plans.fixture import LINES_SQL, WORDS_SQL, lines, words
from tillroll.queries._registry import registry
from tillroll.session import table
from tillroll.sources.ocr import parse_box

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL)

# Words with what an annotator may have left: options, headings and codes among the names, missing labels.
_CASE = "(doc_id + line_no) % 8"
_TEXT = f"""CASE WHEN line_no = 0 THEN text WHEN pos = 0 AND {_CASE} = 0 THEN 'No' WHEN pos = 1 AND {_CASE} = 0 THEN 'Ice' WHEN pos = 0 AND {_CASE} = 1 THEN 'Air-Miles' WHEN pos = 0 AND {_CASE} = 2 THEN 'GROCERYFT2'
    WHEN pos = 0 AND {_CASE} = 3 THEN '04011' WHEN pos = 1 AND {_CASE} = 4 THEN '500 ml' WHEN pos = 1 AND {_CASE} = 5 THEN '*GST*' WHEN pos = 1 AND {_CASE} = 6 THEN '2xCoperto' ELSE text END"""
_FIELD = "CASE WHEN line_no > 0 AND pos = 2 AND doc_id % 3 = 0 THEN 'O' WHEN line_no > 0 AND pos = 2 AND doc_id % 3 = 1 THEN 'ITEM_NAME' WHEN pos = 4 AND (doc_id + line_no) % 5 = 0 THEN 'O' ELSE substr(gold_label, 3) END"
_LEFT = f"SELECT doc_id, word_idx, line_no, {_TEXT} AS text, {_FIELD} AS field FROM "


def _left(spark, sf_dir):
    return words(spark, sf_dir).selectExpr("doc_id", "word_idx", "line_no", f"{_TEXT} AS text", f"{_FIELD} AS field")


@query(f"""WITH w AS (SELECT *, upper(text) AS t, coalesce(lag(field) OVER d = 'ITEM_NAME' AND lag(line_no) OVER d = line_no, false) AS goes FROM ({_LEFT} ({WORDS_SQL})) WINDOW d AS (PARTITION BY doc_id ORDER BY word_idx)),
    r AS (SELECT *, sum(CASE WHEN field = 'ITEM_NAME' AND NOT goes THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY word_idx) AS run FROM w),
    p AS (SELECT doc_id, run, string_agg(t, ' ' ORDER BY word_idx) AS phrase FROM r WHERE field = 'ITEM_NAME' GROUP BY ALL),
    a AS (SELECT r.*, CASE WHEN field <> 'ITEM_NAME' THEN NULL WHEN phrase IN ('NO ICE', 'LARGE', 'SMALL') THEN ['ITEM_OPTION', 'option phrase'] WHEN t = '2XCOPERTO' THEN ['SERVICE_NAME', 'service'] WHEN t = 'AIR-MILES' THEN ['PAYMENT_INFO', 'membership']
        WHEN t = 'GROCERYFT2' THEN ['ITEM_CATEGORY', 'category header'] WHEN t = '500 ML' THEN ['ITEM_OPTION', 'size'] WHEN regexp_full_match(t, '[0-9]{{1,3}}X') THEN ['ITEM_QTY', 'quantity'] WHEN t = '*GST*' THEN ['ITEM_TAX_FLAG', 'tax flag'] WHEN regexp_full_match(t, '[0-9]{{4,}}') THEN ['ITEM_CODE', 'code'] END AS c
        FROM r LEFT JOIN p ON r.doc_id = p.doc_id AND r.run = p.run),
    b AS (SELECT *, coalesce(c[1], field) AS now FROM a),
    g AS (SELECT doc_id, line_no, bool_or(now = 'ITEM_NAME') AND bool_or(now = 'ITEM_PRICE') AS item, bool_or(now = 'ITEM_QTY' OR regexp_full_match(t, '[0-9]{{1,3}}X')) AS counted FROM b GROUP BY ALL),
    z AS (SELECT b.*, CASE WHEN NOT item OR now <> 'O' THEN NULL WHEN regexp_full_match(t, '[0-9]{{4,}}') THEN ['ITEM_CODE', 'code in row'] WHEN regexp_full_match(t, '[0-9]{{1,3}}X') THEN ['ITEM_QTY', 'quantity in row'] WHEN regexp_full_match(t, '[0-9]{{1,6}}[.][0-9]{{2}}') AND counted THEN ['ITEM_UNIT_PRICE', 'price in row with quantity'] END AS l FROM b JOIN g USING (doc_id, line_no))
    SELECT doc_id, word_idx, text, field, coalesce(l[1], now) AS new_field, coalesce(l[2], c[2]) AS reason FROM z""")
def item_policy_fields(spark, sf_dir):
    return C.item_policy(_left(spark, sf_dir), together=True).drop("line_no")


# A relation of each line, from the words of its name to those of its price; some name a word that is not there.
_FIRST = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) * 5 - 4 AS INT)"
_RELATIONS = f"SELECT doc_id, 'r' || lpad(CAST(line_no AS STRING), 4, '0') AS relation_id, line_no, {_FIRST} AS k FROM "
_SIDES = "SELECT doc_id, relation_id, CASE WHEN line_no % 9 = 8 THEN 'menu.nm' ELSE 'ITEM_NAME' END AS head_field, {list}(k, k + 1) AS head_words, 'ITEM_PRICE' AS tail_field, CASE WHEN doc_id % 5 = 0 THEN {list}(k + 2, k + 3, 9999) WHEN doc_id % 11 = 1 THEN {list}(k + 4) ELSE {list}(k + 2, k + 3) END AS tail_words FROM "


def _relations(spark, sf_dir):
    return spark.sql(_SIDES.format(list="array") + "(" + _RELATIONS + "{l})", l=lines(spark, sf_dir).select("doc_id", "line_no"))


def _labelled(spark, sf_dir):
    return words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label")))


def _sql_repair() -> str:
    fields = "CASE WHEN pred_label = 'O' THEN 'O' WHEN substr(pred_label, 3) = 'MENU_PRICE' THEN 'ITEM_PRICE' WHEN substr(pred_label, 3) = 'menu.nm' THEN 'ITEM_NAME' ELSE substr(pred_label, 3) END"
    return f"""WITH words AS ({WORDS_SQL}), rel AS MATERIALIZED ({_SIDES.format(list='list_value')} ({_RELATIONS} ({LINES_SQL}))),
    w AS MATERIALIZED (SELECT doc_id, word_idx, text, {fields} AS field, x0, y0, x1, y1 FROM words),
    s AS (SELECT doc_id, relation_id, 'head' AS side, 'ITEM_NAME' AS want, unnest(head_words) AS word_idx FROM rel UNION ALL SELECT doc_id, relation_id, 'tail', 'ITEM_PRICE', unnest(tail_words) FROM rel),
    j AS (SELECT s.*, text, field, coalesce(field = want, false) AS fits, x0, y0, x1, y1 FROM s LEFT JOIN w USING (doc_id, word_idx))"""


_SIDE = lambda side: f"coalesce(string_agg(word_idx::VARCHAR, ',' ORDER BY word_idx) FILTER (fits AND side = '{side}'), '') AS {side}_ids, coalesce(string_agg(text, ' ' ORDER BY word_idx) FILTER (fits AND side = '{side}'), '') AS {side}_text, count_if(side = '{side}' AND field IS NOT NULL) AS {side}_valid, count_if(side = '{side}') AS {side}_given, count_if(side = '{side}' AND fits) AS {side}_fit"


@query(f"""{_sql_repair()}, g AS (SELECT doc_id, relation_id, {_SIDE("head")}, {_SIDE("tail")}, coalesce(min(x0) FILTER (fits AND side = 'head'), -1) AS head_x0, coalesce(max(y1) FILTER (fits AND side = 'tail'), -1) AS tail_y1 FROM j GROUP BY ALL)
    SELECT doc_id, relation_id, head_ids, head_text, head_x0, tail_ids, tail_text, tail_y1, head_fit > 0 AND tail_fit > 0 AS kept,
        concat_ws(', ', CASE WHEN head_valid > 0 AND head_fit = 0 THEN 'head: no word of its field' END, CASE WHEN tail_valid < tail_given THEN 'tail: word out of range' END, CASE WHEN tail_valid > 0 AND tail_fit = 0 THEN 'tail: no word of its field' END) AS warnings FROM g""")
def relation_repair(spark, sf_dir):
    made = C.repair_relations(_relations(spark, sf_dir), _labelled(spark, sf_dir))
    return made.select("doc_id", "relation_id", F.array_join("head_words", ",").alias("head_ids"), "head_text", F.coalesce("head_x0", F.lit(-1)).alias("head_x0"), F.array_join("tail_words", ",").alias("tail_ids"), "tail_text", F.coalesce("tail_y1", F.lit(-1)).alias("tail_y1"), "kept", F.array_join("warnings", ", ").alias("warnings"))


@query(f"""{_sql_repair()}, k AS (SELECT doc_id, relation_id FROM j WHERE fits GROUP BY ALL HAVING count(DISTINCT side) = 2), l AS (SELECT DISTINCT doc_id, word_idx, relation_id FROM j JOIN k USING (doc_id, relation_id) WHERE fits)
    SELECT w.doc_id, w.word_idx, coalesce(string_agg(relation_id, ',' ORDER BY relation_id), '') AS relation_ids FROM w LEFT JOIN l USING (doc_id, word_idx) GROUP BY ALL""")
def relation_word_links(spark, sf_dir):
    held = _labelled(spark, sf_dir)
    made = C.repair_relations(_relations(spark, sf_dir), held).where("kept")
    return C.link_words(held.select("doc_id", "word_idx"), made).withColumn("relation_ids", F.array_join("relation_ids", ","))


_DECISIONS = "SELECT o_custkey AS doc_id, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'item' WHEN 1 THEN 'summary' WHEN 2 THEN 'payment' ELSE 'other' END AS source, CASE o_orderkey % 7 WHEN 0 THEN 'tax_amount' WHEN 1 THEN 'payment_card' WHEN 2 THEN 'item_attribute' END AS relation_type, CASE WHEN o_orderkey % 3 = 0 THEN 'TOTAL_NAME' ELSE 'ITEM_NAME' END AS head_field FROM "


@query(f"""WITH d AS (SELECT *, coalesce(relation_type, CASE source WHEN 'summary' THEN 'summary_amount' WHEN 'payment' THEN 'payment_attribute' ELSE 'item_attribute' END) AS kind, list_position(['item', 'summary', 'payment', 'other'], source) AS k FROM ({_DECISIONS} orders)),
    e AS (SELECT *, (kind = 'item_attribute' AND head_field = 'ITEM_NAME')::INT AS edge FROM d)
    SELECT doc_id, ordinal, source, kind AS relation_type, head_field, CASE WHEN source = 'summary' OR kind IN ('summary_amount', 'tax_amount') THEN 'summary' WHEN source = 'payment' OR kind LIKE 'payment%' THEN 'payment' ELSE 'item' END AS route,
        format('r_{{:06d}}', row_number() OVER o - 1) AS relation_id, CASE WHEN edge = 1 THEN format('g_{{:06d}}', (sum(edge) OVER o)::BIGINT - 1) END AS edge_id FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY k, ordinal)""")
def decision_routes(spark, sf_dir):
    return C.route_decisions(spark.sql(_DECISIONS + "{o}", o=table(spark, sf_dir, "orders")))


#: Rules over the words of the parts' names; rules for real items come from a file of the same three columns.
RULES = [("TRANSPORT", 0.9, "old gear"), ("HOUSEHOLD", 0.85, "plate"), ("ELECTRONICS", 0.8, "gizmo"), ("CLOTHING", 0.8, "ring"), ("HOUSEHOLD", 0.85, "widget"), ("SERVICE", 0.7, "rod & bolt"), ("SNACK", 0.75, "hot"), ("FOOD", 0.7, "old")]
OVERRIDES = {"red-widget": "ENTERTAINMENT", "Blue Anvil": "HEALTH"}
# The name as a recogniser may have read it: apart, run together, or with a joined mark.
_READ = "CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '') WHEN 1 THEN replace(p_name, ' ', ' & ') ELSE p_name END"
_VALUES = ", ".join(f"({i}, '{c}', {p}::DOUBLE, '{k}', '{k.upper().replace('&', 'AND')}')" for i, (c, p, k) in enumerate(RULES))
_CATEGORISED = f"""WITH t AS (SELECT p_partkey, {_READ} AS item, trim(regexp_replace(replace(upper({_READ}), '&', ' AND '), '[^0-9A-Z]+', ' ', 'g')) AS n FROM part), r(i, c, p, k, key) AS (VALUES {_VALUES}),
    m AS (SELECT p_partkey, arg_min({{'c': c, 'p': p, 'k': k}}, i) AS best FROM t JOIN r ON contains(' ' || n || ' ', ' ' || key || ' ') OR (length(replace(key, ' ', '')) >= 6 AND contains(replace(n, ' ', ''), replace(key, ' ', ''))) GROUP BY 1),
    q AS (SELECT p_partkey, item, CASE n WHEN 'RED WIDGET' THEN 'ENTERTAINMENT' WHEN 'BLUE ANVIL' THEN 'HEALTH' END AS o, best FROM t LEFT JOIN m USING (p_partkey)),
    a AS (SELECT p_partkey, item, coalesce(o, best.c, 'OTHER') AS category, CASE WHEN o IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(best.p, 0.35::DOUBLE) END AS category_confidence, CASE WHEN o IS NOT NULL THEN 'override' ELSE coalesce(best.k, 'none') END AS category_rule FROM q)"""


def _categorised(spark, sf_dir):
    return C.categorise(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_READ} AS item"), "item", RULES, OVERRIDES)


@query(f"{_CATEGORISED} SELECT * FROM a")
def item_categories(spark, sf_dir):
    return _categorised(spark, sf_dir)


@query(f"{_CATEGORISED} SELECT category, category_rule, count(*) AS n, GROUPING(category_rule)::INT AS whole FROM a GROUP BY ROLLUP (category, category_rule)")
def category_counts(spark, sf_dir):
    return _categorised(spark, sf_dir).rollup("category", "category_rule").agg(F.count("*").alias("n"), F.grouping("category_rule").cast("int").alias("whole"))


# One record a line: a broken box, an unknown label, a box beyond the scale, or arrays of unequal length in some.
_RECORDS = """SELECT doc_id, line_no, CASE WHEN doc_id % 10 = 3 THEN {array}() ELSE {array}(name_1, name_2) END AS words, {array}({array}(1, 1, 5, 5), {array}(5, 1, CASE WHEN doc_id % 7 = 2 THEN 5 ELSE 9 END, 5)) AS boxes,
    {array}({array}(CASE WHEN doc_id % 6 = 1 THEN -1 ELSE 0 END, 0, 10, 10), {array}(10, 0, CAST(900 + qty * 3 AS INT), 10)) AS normalized_boxes, {array}('B-ITEM_NAME', CASE WHEN doc_id % 4 = 0 THEN 'B-NOTHING' WHEN doc_id % 4 = 1 THEN 'IGNORE' ELSE 'O' END) AS labels FROM """


@query(f"""WITH r AS ({_RECORDS.format(array='list_value')} ({LINES_SQL})) SELECT doc_id, line_no, concat_ws(', ', CASE WHEN len(words) = 0 THEN 'no words' END, CASE WHEN len(words) <> 2 THEN 'unequal lengths' END, CASE WHEN doc_id % 4 = 0 THEN 'unknown label at 1' END,
    CASE WHEN len(words) = 2 AND boxes[2][3] <= 5 THEN 'bad box at 1' END, CASE WHEN len(words) = 2 AND normalized_boxes[1][1] < 0 THEN 'bad normalised box at 0' WHEN len(words) = 2 AND normalized_boxes[2][3] > 1000 THEN 'bad normalised box at 1' END) AS errors FROM r""")
def record_errors(spark, sf_dir):
    made = spark.sql(_RECORDS.format(array="array").replace("array() ", "cast(array() AS array<string>) ") + "{l}", l=lines(spark, sf_dir))
    return C.record_errors(made, ["O", "B-ITEM_NAME"]).select("doc_id", "line_no", F.array_join("errors", ", ").alias("errors"))


@query(f"""WITH words AS ({WORDS_SQL}), w AS (SELECT doc_id, line_no, CASE WHEN doc_id % 13 = 1 AND pred_label LIKE '%PRICE%' THEN NULL WHEN doc_id % 13 = 2 AND pred_label LIKE '%NAME%' THEN 'O' ELSE pred_label END AS label FROM words),
    g AS (SELECT doc_id, count_if(label LIKE '%ITEM_NAME%') AS name_words, count_if(label LIKE '%ITEM_PRICE%') AS price_words FROM w GROUP BY ALL),
    r AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, line_no FROM w GROUP BY ALL HAVING count_if(label LIKE '%ITEM_NAME%') > 0 AND count_if(label LIKE '%ITEM_PRICE%') > 0) GROUP BY ALL)
    SELECT doc_id, name_words, price_words, coalesce(k, 0) AS n_relations, concat_ws(', ', CASE WHEN price_words > 0 AND name_words = 0 THEN 'price without name' END, CASE WHEN name_words > 0 AND price_words = 0 THEN 'name without price' END, CASE WHEN k IS NULL THEN 'no relations' END) AS issues FROM g LEFT JOIN r USING (doc_id)""")
def label_presence_audit(spark, sf_dir):
    held = words(spark, sf_dir).selectExpr("doc_id", "line_no", "CASE WHEN doc_id % 13 = 1 AND pred_label LIKE '%PRICE%' THEN NULL WHEN doc_id % 13 = 2 AND pred_label LIKE '%NAME%' THEN 'O' ELSE pred_label END AS label")
    has = lambda field: F.count_if(F.col("label").contains(field)) > 0
    related = held.groupBy("doc_id", "line_no").agg(has("ITEM_NAME").alias("a"), has("ITEM_PRICE").alias("b")).where("a AND b").select("doc_id")
    return C.audit_labels(held.drop("line_no"), related).withColumn("issues", F.array_join("issues", ", "))


#: The same box as named corners, an array of corners, of corner points, and of a corner and a size.
_SHAPES = """CASE word_idx % 4 WHEN 0 THEN format_string('{"left": %d, "top": %d, "right": %d, "bottom": %d}', x0, y0, x1, y1) WHEN 1 THEN format_string('{"bbox": [%d, %d, %d, %d]}', x0, y0, x1, y1)
    WHEN 2 THEN format_string('{"quad": [%d, %d, %d, %d, %d, %d, %d, %d]}', x0, y0, x1, y0, x1, y1, x0, y1) ELSE format_string('{"box": [%d, %d, %d, %d]}', x0, y0, x1 - x0, y1 - y0) END"""


@query(f"SELECT doc_id, word_idx, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM ({WORDS_SQL})")
def box_parse_shapes(spark, sf_dir):
    held = words(spark, sf_dir).withColumn("element", F.parse_json(F.expr(_SHAPES)))
    return held.withColumn("box", parse_box(F.col("element"))).select("doc_id", "word_idx", *[F.col("box")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"""WITH w AS (SELECT doc_id, word_idx, x0, y0, x1, y1, page_w, page_h, d, radians(d) AS a FROM ({WORDS_SQL}), (VALUES (-5.0::DOUBLE), (5.0::DOUBLE)) AS t(d)),
    c AS (SELECT *, ceil(round(page_w * abs(cos(a)) + page_h * abs(sin(a)), 9)) AS w, ceil(round(page_w * abs(sin(a)) + page_h * abs(cos(a)), 9)) AS h FROM w),
    p AS (SELECT doc_id, word_idx, d, unnest([x0, x1, x1, x0]) - page_w / 2 AS u, unnest([y0, y0, y1, y1]) - page_h / 2 AS v, a, w, h FROM c),
    q AS (SELECT doc_id, word_idx, d, cos(a) * u + sin(a) * v + w / 2 AS x, cos(a) * v - sin(a) * u + h / 2 AS y FROM p)
    SELECT doc_id, word_idx, d AS degrees, floor(min(x) * 1000 + 0.5)::BIGINT AS x0, floor(min(y) * 1000 + 0.5)::BIGINT AS y0, floor(max(x) * 1000 + 0.5)::BIGINT AS x1, floor(max(y) * 1000 + 0.5)::BIGINT AS y1 FROM q GROUP BY ALL""")
def rotate_boxes(spark, sf_dir):
    """Boxes of the words on a turned page, in thousandths of a pixel."""
    held = words(spark, sf_dir).withColumn("degrees", F.explode(F.array(F.lit(-5.0), F.lit(5.0))))
    corners = [G.rotate_point(F.col(x), F.col(y), F.col("page_w"), F.col("page_h"), F.col("degrees")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    xs, ys = zip(*corners)
    sides = {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}
    return held.select("doc_id", "word_idx", "degrees", *[F.floor(c * 1000 + 0.5).cast("bigint").alias(k) for k, c in sides.items()])
