"""Queries over lines, tokens and splits of the receipts of plans.fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import labels as L
from tillroll.operators import layout as Y
from tillroll.operators import metrics as M
from tillroll.operators import pairs as P
from tillroll.operators import splits as Z
from tillroll.operators import tokens as T
from tillroll.plans.fixture import words
from tillroll.queries import receipts as R
from tillroll.queries._registry import registry
from tillroll.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL)

_WORDS = R._WORDS
_BOX = ("x0", "y0", "x1", "y1")


@query(f"{_WORDS} SELECT doc_id, word_idx, min(x0) OVER l AS line_x0, min(y0) OVER l AS line_y0, max(x1) OVER l AS line_x1, max(y1) OVER l AS line_y1 FROM words WINDOW l AS (PARTITION BY doc_id, line_no)")
def line_boxes(spark, sf_dir):
    return Y.with_line_box(words(spark, sf_dir)).select("doc_id", "word_idx", *[f"line_{c}" for c in _BOX])


_LINES = "SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY word_idx) AS text, count(*) AS n_words, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM words GROUP BY ALL"


@query(f"{_WORDS} {_LINES}")
def line_rollup(spark, sf_dir):
    return Y.line_rollup(words(spark, sf_dir))


@query(f"{_WORDS}, l AS ({_LINES}) SELECT doc_id, (line_no // 4)::INT AS block, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS n_lines, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM l GROUP BY ALL")
def block_rollup(spark, sf_dir):
    lines = Y.line_rollup(words(spark, sf_dir)).withColumn("block", F.floor(F.col("line_no") / 4).cast("int"))
    return Y.block_rollup(lines, "block")


@query(f"""{_WORDS}, l AS ({_LINES}), o AS (SELECT w.doc_id, w.line_no, w.text, l.x0, l.x1, l.y0, l.y1, length(l.text) AS whole, (row_number() OVER p - 1)::INT AS place, sum(length(w.text) + 1) OVER p - length(w.text) - 1 AS start FROM words w JOIN l ON w.doc_id = l.doc_id AND w.line_no = l.line_no WINDOW p AS (PARTITION BY w.doc_id, w.line_no ORDER BY word_idx))
    SELECT doc_id, line_no, place, text, round(x0 + (x1 - x0) * (start / whole), 6) AS left_x, round(x0 + (x1 - x0) * ((start + length(text)) / whole), 6) AS right_x, round(y1 + 6 * (start / whole), 6) AS below FROM o""")
def word_quads(spark, sf_dir):
    lines = Y.line_rollup(words(spark, sf_dir))
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), y.cast("double").alias("y"))
    quads = lines.withColumn("quad", F.array(point("x0", F.col("y0")), point("x1", F.col("y0") + 6), point("x1", F.col("y1") + 6), point("x0", F.col("y1"))))
    q = F.col("quad")
    return Y.word_quads(quads).select("doc_id", "line_no", "place", "text", F.round(q[0]["x"], 6).alias("left_x"), F.round(q[1]["x"], 6).alias("right_x"), F.round(q[3]["y"], 6).alias("below"))


@query(f"""{R._WITH_FIELD}, v AS (SELECT doc_id, word_idx, line_no, field FROM f WHERE word_idx % 7 <> 0) SELECT doc_id, word_idx, CASE WHEN field = 'O' THEN 'O' WHEN row_number() OVER (PARTITION BY doc_id, line_no, field ORDER BY word_idx) = 1 THEN 'B-' || field ELSE 'I-' || field END AS label FROM v""")
def line_bio(spark, sf_dir):
    broken = words(spark, sf_dir).withColumn("field", L.label_field(F.col("pred_label"))).withColumn("x1", F.when(F.col("word_idx") % 7 == 0, F.col("x0")).otherwise(F.col("x1")))
    return Y.line_bio(broken).select("doc_id", "word_idx", "label")


@query(f"""{_WORDS}, p AS (SELECT doc_id, word_idx, CASE WHEN coalesce(word_idx - lag(word_idx) OVER w > 2, true) THEN 1 ELSE 0 END AS fresh FROM words WHERE pred_label LIKE '%NAME' OR pred_label LIKE '%QTY' WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY word_idx)::BIGINT - 1 AS "group" FROM p) SELECT doc_id, "group", min(word_idx) AS first, max(word_idx) AS last, count(*) AS n FROM g GROUP BY ALL""")
def gap_groups(spark, sf_dir):
    return Y.gap_groups(words(spark, sf_dir).where("pred_label LIKE '%NAME' OR pred_label LIKE '%QTY'"))


@query(f"{_WORDS} SELECT doc_id, word_idx, round_even(x0 * 1.25, 0)::INT AS x0, round_even(y0 * 0.5, 0)::INT AS y0, round_even(x1 * 1.25, 0)::INT AS x1, round_even(y1 * 0.5, 0)::INT AS y1, greatest(0, x0 - 41) AS c0, greatest(0, y0 - 41) AS c1, least(page_w, x1 + 41) AS c2, least(page_h, y1 + 41) AS c3 FROM words")
def rescaled_and_padded(spark, sf_dir):
    box = [F.col(c) for c in _BOX]
    crop = Y.padded(box, 41, F.col("page_w"), F.col("page_h"))
    return words(spark, sf_dir).select("doc_id", "word_idx", *[c.alias(n) for c, n in zip(Y.rescaled(box, F.lit(1.25), F.lit(0.5)), _BOX)], *[c.alias(f"c{k}") for k, c in enumerate(crop)])


# One to three tokens a word, with scores of three labels; some words have none.
_TOKENS = "SELECT doc_id, word_idx, word_idx * 3 + k AS token_idx, (word_idx + k) % 5 AS a, (doc_id + k) % 4 AS b, (x0 + k) % 3 AS c FROM {words} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) WHERE k <= word_idx % 3 AND word_idx % 17 <> 5"


def _tokens(spark, sf_dir):
    made = spark.sql(_TOKENS.replace("{words}", "{w}"), w=words(spark, sf_dir))
    return made.withColumn("scores", F.array(*[F.col(c).cast("double") for c in "abc"])).drop("a", "b", "c")


@query(f"""{_WORDS}, t AS ({_TOKENS.format(words="words")}), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, word_idx ORDER BY token_idx) = 1)
    SELECT w.doc_id, w.word_idx, CASE WHEN a IS NULL THEN 'O' WHEN a >= b AND a >= c THEN 'O' WHEN b >= c THEN 'B-X' ELSE 'I-X' END AS label, round(coalesce(1 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 0), 6) AS confidence FROM words w LEFT JOIN f ON w.doc_id = f.doc_id AND w.word_idx = f.word_idx""")
def first_token_predictions(spark, sf_dir):
    made = T.word_predictions(words(spark, sf_dir).select("doc_id", "word_idx"), _tokens(spark, sf_dir), ["O", "B-X", "I-X"])
    return made.withColumn("confidence", F.round("confidence", 6))


@query(f"""{_WORDS}, t AS ({_TOKENS.format(words="words")}), j AS (SELECT t.doc_id, t.token_idx, t.word_idx, w.x0, row_number() OVER (PARTITION BY t.doc_id, t.word_idx ORDER BY token_idx) AS k FROM t LEFT JOIN words w ON t.doc_id = w.doc_id AND t.word_idx = w.word_idx AND w.word_idx % 4 > 0)
    SELECT doc_id, token_idx, coalesce(x0, 0)::DOUBLE AS every, CASE WHEN k = 1 THEN coalesce(x0, 0) ELSE 0 END::DOUBLE AS first, CASE WHEN word_idx % 6 = 0 THEN -100 ELSE 7 END AS label_id FROM j""")
def token_features(spark, sf_dir):
    w = words(spark, sf_dir)
    held, tokens = w.where("word_idx % 4 > 0").select("doc_id", "word_idx", F.array(F.col("x0").cast("double")).alias("every")), _tokens(spark, sf_dir).drop("scores")
    made = T.on_tokens(T.on_tokens(tokens, held, "every"), held.withColumnRenamed("every", "first"), "first", first_only=True)
    masked = T.mask_ignored(made.withColumn("label_id", F.lit(7)), w.where("word_idx % 6 = 0"))
    return masked.select("doc_id", "token_idx", F.col("every")[0].alias("every"), F.col("first")[0].alias("first"), "label_id")


_TOKEN_METRICS = f"""{_WORDS}, {R._spans_sql('gold_label', 'gold')}, {R._spans_sql('pred_label', 'pred')}, j AS (SELECT g.doc_id AS gd, p.doc_id AS pd FROM gold g FULL JOIN pred p ON g.doc_id = p.doc_id AND g.field = p.field AND g.first_word = p.first_word AND g.last_word = p.last_word),
    c AS (SELECT count_if(gd IS NOT NULL AND pd IS NOT NULL) AS tp, count_if(gd IS NULL) AS fp, count_if(pd IS NULL) AS fn FROM j), t AS (SELECT count(*) AS n_tokens, count_if(gold_label = pred_label) AS n_correct FROM words),
    m AS (SELECT n_tokens, n_correct, round(n_correct / n_tokens, 6) AS accuracy, {R._MEASURES("span", "tp", "fp", "fn")} FROM t, c)"""


@query(f"{_TOKEN_METRICS} SELECT * FROM m")
def token_metrics(spark, sf_dir):
    return R._rounded(M.token_metrics(words(spark, sf_dir), "gold_label", "pred_label"), "accuracy", "span_precision", "span_recall", "span_f1")


@query(f"{_TOKEN_METRICS} SELECT unnest(['n_tokens', 'n_correct', 'accuracy', 'span_precision', 'span_recall', 'span_f1']) AS metric, unnest([n_tokens, n_correct, accuracy, span_precision, span_recall, span_f1]::DOUBLE[]) AS value FROM m")
def metric_rows(spark, sf_dir):
    return M.flattened(token_metrics(spark, sf_dir))


@query(f"{_WORDS} SELECT gold_label AS gold, pred_label AS pred, count(*) AS n FROM words WHERE gold_label <> pred_label GROUP BY ALL ORDER BY n DESC, gold, pred LIMIT 3")
def confusions_without_equal(spark, sf_dir):
    return M.label_confusions(words(spark, sf_dir), "gold_label", "pred_label", 3, diagonal_first=False)


@query(f"{R._PAIRS}, c AS (SELECT dep_field, {R._T}, count_if(gold = 0 AND prob >= {R.S.THRESHOLD} AND {R._HARD}) AS hard_negatives FROM scored GROUP BY dep_field), v AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c) SELECT dep_field, round(f1, 6) AS f1, CASE WHEN f1 >= 0.9 THEN 'strong' WHEN f1 >= 0.8 THEN 'usable' ELSE 'review' END AS verdict, CASE WHEN hard_negatives > 0 THEN 'hard negatives remain' ELSE '' END AS notes FROM v")
def field_verdicts(spark, sf_dir):
    counts = R._counted(spark, sf_dir, [R.S.THRESHOLD])
    made = M.counted_edge_metrics(counts, "dep_field").withColumn("collisions", F.lit(0))
    return M.verdicts(made).select("dep_field", F.round("f1", 6).alias("f1"), "verdict", "notes")


@query(f"{R._PAIRS} SELECT doc_id, pair_index, prob, gold, (prob >= {R.S.THRESHOLD})::INT AS pred, (prob >= {R.S.THRESHOLD}) = (gold = 1) AS correct FROM scored")
def edge_payload(spark, sf_dir):
    return P.edge_payload(R._scored(spark, sf_dir)).select("doc_id", "pair_index", "prob", "gold", "pred", "correct")


@query("SELECT event_type, round(max(abs(value - user_id)), 6) AS max_diff, round(avg(abs(value - user_id)), 6) AS mean_diff, count(value) AS n FROM events GROUP BY event_type")
def value_differences(spark, sf_dir):
    return R._rounded(M.differences(table(spark, sf_dir, "events"), "value", "user_id", "event_type"), "max_diff", "mean_diff")


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def best_checkpoint(spark, sf_dir):
    return M.best_checkpoint(table(spark, sf_dir, "events"), "user_id", "value", "event_id")


@query("WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42:' || o_custkey)) AS r FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, CASE WHEN r <= 30 THEN 'test' WHEN r <= 50 THEN 'validation' ELSE 'train' END AS split FROM orders JOIN k USING (o_custkey)")
def split_seeded(spark, sf_dir):
    return Z.seeded_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 20, 30)


@query("SELECT o_orderkey, coalesce(CASE WHEN c_nationkey < 3 THEN 'test' WHEN c_nationkey < 9 THEN 'validation' END, 'train') AS split FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_nationkey >= 3")
def split_selection(spark, sf_dir):
    nations = table(spark, sf_dir, "customer").where("c_nationkey < 9").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") < 3, "test").otherwise("validation").alias("split"))
    return Z.of_splits(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), nations, "o_custkey", ["train", "validation"]).select("o_orderkey", "split")


@query("SELECT page_id FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['wiki', 'a', 'docs', 'http:']) AND page_id IN (SELECT doc_id FROM labels)")
def listed_pages(spark, sf_dir):
    some = Z.outside(table(spark, sf_dir, "pages"), "url", ["wiki", "a", "docs", "http:"])
    return Z.listed(some, table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "page_id"), "page_id").select("page_id")


@query(f"{_WORDS}, o AS (SELECT doc_id, word_idx, CASE WHEN word_idx % 9 = 4 THEN replace(text, '1', 'l') ELSE text END AS text FROM words WHERE NOT (doc_id % 7 = 0 AND word_idx > 5)) SELECT coalesce(w.doc_id, o.doc_id) AS doc_id, coalesce(w.word_idx, o.word_idx) AS word_idx, w.text AS left_text, o.text AS right_text FROM words w FULL JOIN o ON w.doc_id = o.doc_id AND w.word_idx = o.word_idx WHERE w.text IS DISTINCT FROM o.text")
def positional_compare(spark, sf_dir):
    w = words(spark, sf_dir)
    other = w.where("NOT (doc_id % 7 = 0 AND word_idx > 5)").withColumn("text", F.when(F.col("word_idx") % 9 == 4, F.replace("text", F.lit("1"), F.lit("l"))).otherwise(F.col("text")))
    return Z.compared(w, other)
