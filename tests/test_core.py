"""The receipt operators against literals and DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.functions import geometry as G
from tillroll.functions import labels as L
from tillroll.functions import text as X
from tillroll.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("label,expected", [("B-MENU_PRICE", "B-ITEM_PRICE"), ("I-menu.nm", "I-ITEM_NAME"), ("ITEM_QTY", "B-ITEM_QTY"), (" ", "O"), (None, "O"), ("B-UNKNOWN", "B-UNKNOWN"), ("I-sub-total/etc", "I-PAYMENT_INFO")])
def test_canonical_label(spark, label, expected):
    assert value(spark, L.canonical_label(F.lit(label).cast("string"))) == expected


def test_span_text(spark):
    assert value(spark, L.span_text(F.lit("ITEM_PRICE"), F.lit("$ 16 . 99"))) == "$16.99"
    assert value(spark, L.span_text(F.lit("ITEM_NAME"), F.lit("  SKINCARE   & MAK "))) == "SKINCARE & MAK"


def test_geometry(spark):
    quad = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    assert value(spark, G.box_of_quad(quad((10, 20), (110, 25), (108, 50), (8, 45)))) == [8, 20, 110, 50]
    assert abs(value(spark, G.quad_angle(quad((0, 0), (100, 10), (100, 30), (0, 20)))) - 5.7106) < 0.1
    assert [value(spark, G.normal_angle(F.lit(float(a)))) for a in (91, -91, 180)] == [-89, 89, 0]
    box = [F.lit(v) for v in (2.5, 3.5, -1.0, 900.0)]
    assert value(spark, G.clamp(box, F.lit(100), F.lit(50))) == [0, 4, 2, 49]
    assert value(spark, G.clamp(box, F.lit(100), F.lit(50), swap=False)) is None


def test_ocr_measures(spark):
    truth, found = F.lit("12.30"), F.lit("1230")
    assert value(spark, X.cer(truth, found)) == 0.2 and value(spark, X.character_accuracy(truth, found)) == 0.8
    assert value(spark, X.count_mismatch(truth, found, ".")) == 1
    assert value(spark, X.cer(F.lit(""), F.lit(""))) == 0 and value(spark, X.cer(F.lit(""), F.lit("x"))) == 1
    for text in ("12.30", "-1,234.50", "₩10,000", "$5.20", "10%", "****1234"):
        assert value(spark, X.is_numeric_token(F.lit(text)))
    assert value(spark, X.corrected_number(F.lit("O.99"))) == "0.99" and value(spark, X.amount(F.lit("1.2.3"))) == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = c.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(expected.columns)
    norm = lambda row: tuple(f"{v:.9g}" if isinstance(v, float) else repr([f"{x:.9g}" for x in v]) if isinstance(v, list | tuple) and v and isinstance(v[0], float) else repr(int(v)) if isinstance(v, bool) else repr(v) for v in row)
    assert sorted(map(norm, found.select(*expected.columns).collect())) == sorted(map(norm, expected.fetchall()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_greedy_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_sources(spark, tmp_path):
    from tillroll.sources import ocr, sinks

    (tmp_path / "a.jsonl").write_text('{"capture_id": "x", "words": [{"text": "A", "box": [1, 2, 3, 4]}, {"text": " ", "box": [1, 2, 3, 4]}]}\n\n# note\nimg.png\t{"capture_id": "x", "lines": [{"text": "B", "bbox": [5, 5, 2, 2]}], "blocks": [{"text": "C", "quad": [0, 0, 9, 1, 9, 8, 0, 7]}]}\n')
    lines = ocr.json_lines(spark, str(tmp_path / "a.jsonl"))
    assert [(r["line_no"], r["p"]) for r in lines.select("line_no", F.col("parsed").isNotNull().alias("p")).orderBy("line_no").collect()] == [(1, True), (3, False), (4, True)]
    assert ocr.last_decisions(lines).first()["line_no"] == 4
    words = ocr.words_of_pages(lines.where("parsed IS NOT NULL").select(F.col("line_no").alias("doc_id"), F.col("parsed").alias("page")))
    assert [tuple(r) for r in words.orderBy("doc_id", "word_idx").collect()] == [(1, 0, "A", [1, 2, 3, 4]), (4, 0, "B", [5, 5, 7, 7]), (4, 1, "C", [0, 0, 9, 8])]
    sinks.write_csv(words, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["box", "doc_id", "text", "word_idx"]
    assert sinks.manifest(spark, str(tmp_path / "a.jsonl")).count() == 1


def test_lines_of_blocks(spark, tmp_path):
    """Line numbers over the blocks of a file, with blank lines and Windows ends."""
    from tillroll.sources import ocr

    text = "".join(f'{{"id": {k}}}' + ("\r\n" if k % 3 else "\n\n") for k in range(3000)) + 'a.png\t{"id": -1}\nno json'
    (tmp_path / "a.jsonl").write_text(text, newline="")
    (tmp_path / "b.jsonl").write_text('{"id": 7}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        rows = ocr.json_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = {(r["path"][-7:], r["line_no"]): r["value"] for r in rows}
    expected = {("a.jsonl", k): x.rstrip("\r") for k, x in enumerate(text.split("\n"), 1) if x.strip()} | {("b.jsonl", 1): '{"id": 7}'}
    assert found == expected
    assert [(r["file_name"], r["parsed"] is None) for r in rows if r["value"].startswith(("a.png", "no"))] == [("a.png", False), (None, True)]


def test_summary_and_report(spark, tmp_path):
    from tillroll.sources import sinks

    df = spark.createDataFrame([(1, "a|b", None)], "n int, t string, z int")
    sinks.write_summary(df, str(tmp_path / "s"), ["t", "missing", "n"])
    assert next((tmp_path / "s").glob("*.csv")).read_text() == "t,missing,n\na|b,,1\n"
    sinks.write_report(df, str(tmp_path / "r"))
    import json

    assert json.loads(next((tmp_path / "r").glob("*.txt")).read_text()) == {"n": 1, "t": "a|b", "z": None}
    assert sinks.markdown_table(df) == ["| n | t | z |", "|---|---|---|", "| 1 | a\\|b |  |"]
    with pytest.raises(Exception, match="exists"):
        sinks.write_report(df, str(tmp_path / "r"))


def test_streams(spark, tmp_path):
    from tillroll.streaming import events as E

    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = E.windowed_spend(E.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("spend").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("spend").agg(F.sum("n")).first()[0] == 1000


# Curation: literals, and rows with nulls, empty texts and repeats.
from tillroll.operators import curation as C  # noqa: E402

POLICY = "doc_id bigint, word_idx int, line_no int, text string, field string, extra string"


def policy(spark, rows):
    made = C.item_policy(spark.createDataFrame([(*r, "x") for r in rows], POLICY))
    assert made.columns[-3:] == ["extra", "new_field", "reason"]
    return {(r["doc_id"], r["word_idx"]): (r["new_field"], r["reason"]) for r in made.collect()}


def test_policy_first_pass(spark):
    names = ["To", "Go", None, "", "12OZ", "$4.50", "2X", "*GST*", "AIRMILES1", "OPENFOOD9", "0456MEAT", "3XCOPERTO", "SKU-1234", "tea"]
    got = policy(spark, [(1, i, None if i > 1 else 5, t, "ITEM_NAME") for i, t in enumerate(names)])
    assert [got[1, i][0] for i in range(len(names))] == ["ITEM_OPTION", "ITEM_OPTION", "ITEM_NAME", "ITEM_NAME", "ITEM_OPTION", "ITEM_PRICE", "ITEM_QTY", "ITEM_TAX_FLAG", "PAYMENT_INFO", "ITEM_ETC", "ITEM_CATEGORY", "SERVICE_NAME", "ITEM_CODE", "ITEM_NAME"]


def test_policy_rows(spark):
    row = [("tea", "ITEM_NAME"), ("3.00", "ITEM_PRICE"), ("1.50", "O"), ("88123", None), ("5KG", "O"), ("note", "O")]
    got = policy(spark, [(1, i, 1, t, f) for i, (t, f) in enumerate(row)] + [(1, 6 + i, 2, t, f) for i, (t, f) in enumerate([*row, ("2X", "O")])])
    assert [got[1, i][0] for i in range(6)] == ["ITEM_NAME", "ITEM_PRICE", "O", "ITEM_CODE", "ITEM_OPTION", "O"]
    assert got[1, 8] == ("ITEM_UNIT_PRICE", "price in row with quantity") and got[1, 12][0] == "ITEM_QTY"


def test_policy_order_and_phrases(spark):
    names = ["No", " ", None, "ice", "to go", "to", "go", "now"]
    made = [(1, i, 1 if i < 4 else i if i < 5 else 9, t, "ITEM_NAME") for i, t in enumerate(names)]
    got = policy(spark, [*reversed(made), (1, None, None, "large", "ITEM_NAME"), (None, 3, 1, "large", "ITEM_NAME"), (2, 4, 1, "large", "ITEM_NAME"), (2, 6, 1, "ice", "ITEM_NAME"), (2, 5, 2, "x", "O")])
    options = {k for k, v in got.items() if v == ("ITEM_OPTION", "option phrase")}
    assert options == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, None), (None, 3), (2, 4)}


def test_kinds_of_one_text_as_columns(spark):
    from tillroll.functions import policy as Y

    kinds = [k for k, *_ in Y.KINDS]
    words = ["12OZ", "$4.50", "2X", "x 3", "2\u2028", "2X\u2028", "2X\x85\u2028", "*gst*", "**", "**T\u2029", "AirMiles-1", "misc", "OPENFOOD\u2028", "OPENFOOD\u2028\u2028", "0456MEAT", "3XCOPERTO", "SKU-1234", "#1234AB", "a@b-12345", "12/34567\u2028x", "cad 1,234.50-", "(1.50)", "1.5", "\u0661\u0662X", "1\u00a0X", "1\x0bX", "\u00df1234", "qty", "tea", "", " ", None, "500 ml", "2 x 3 kg", "A123", "ab1234567890"]
    held = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, t string")
    for r in held.select("*", *[Y.is_kind(F.col("t"), k).alias(k) for k in dict.fromkeys(kinds)], Y.written(F.col("t")).alias("w")).collect():
        assert Y.written_text(r["t"]) == r["w"]
        assert {k: Y.first_kind(r["t"], (k,)) == 0 for k in kinds} == {k: r[k] for k in kinds}, r["t"]


def test_policy_needs_no_shuffle_after_words(spark):
    plan = QUERIES["item_policy_fields"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan.partition("Generate explode(CASE")[0]
    assert not [w for w in ("Sort", "Join", "Window", "regexp_replace", "hashpartitioning(doc_id") if w in after]


def test_policy_empty(spark):
    assert policy(spark, []) == {}


def test_relations(spark):
    held = spark.createDataFrame([(1, 0, "ITEM_NAME", " tea ", 1, 1, 4, 4), (1, 1, "ITEM_PRICE", "3.00", 6, 0, 9, 5), (1, 2, None, None, 0, 0, 1, 1)], "doc_id bigint, word_idx int, field string, text string, x0 int, y0 int, x1 int, y1 int")
    sides = [("a", "ITEM_NAME", [0, 1], "ITEM_PRICE", [1]), ("b", "ITEM_NAME", [0, 7], "TOTAL_PRICE", [1]), ("c", "ITEM_NAME", None, "O", [1, 2]), ("d", None, [2, 0], "ITEM_PRICE", [1]), ("e", "ITEM_NAME", [], "ITEM_PRICE", [9])]
    relations = spark.createDataFrame([(1, *s) for s in sides], "doc_id bigint, relation_id string, head_field string, head_words array<int>, tail_field string, tail_words array<int>")
    repaired = C.repair_relations(relations, held)
    got = {r["relation_id"]: r for r in repaired.collect()}
    assert {k: r["kept"] for k, r in got.items()} == {"a": True, "b": False, "c": False, "d": True, "e": False}
    assert (got["a"]["head_words"], got["a"]["head_text"], got["a"]["tail_x1"]) == ([0], "tea", 9)
    assert got["b"]["warnings"] == ["head: word out of range", "tail: no word of its field"]
    assert got["c"]["warnings"] == ["head: no words"] and got["e"]["warnings"] == ["head: no words", "tail: word out of range"]
    assert got["d"]["head_words"] == [2, 0]
    links = C.link_words(held, repaired.where("kept"))
    assert {r["word_idx"]: r["relation_ids"] for r in links.collect()} == {0: ["a", "d"], 1: ["a", "d"], 2: ["d"]}


def test_categories(spark):
    items = ["Iced Latte", "LATTEICED", "ICEDLATTE x", "Tart&Tea", "tartAndTea", "platter", "", None, "Zed"]
    rules = [("DRINK", 0.8, "iced latte"), ("FOOD", 0.7, "tart & tea"), ("FOOD", 0.7, "latte"), ("X", 0.1, "--")]
    made = C.categorise(spark.createDataFrame([(i, "kept") for i in items], "item string, category_note string"), "item", rules, {"zed": "HEALTH"})
    got = [tuple(r)[2:] for r in made.collect()]
    other = ("OTHER", 0.35, "none")
    assert got == [("DRINK", 0.8, "iced latte"), other, ("DRINK", 0.8, "iced latte"), ("FOOD", 0.7, "tart & tea"), ("FOOD", 0.7, "tart & tea"), other, ("OTHER", 0.0, "empty"), ("OTHER", 0.0, "empty"), ("HEALTH", 1.0, "override")]
    more = [*rules, *[("NEVER", 0.1, f"none{k}") for k in range(C.RULES_IN_PLAN)]]  # too many for the plan
    joined = C.categorise(spark.createDataFrame([(i, "kept") for i in items], "item string, category_note string"), "item", more, {"zed": "FIRST", "Zed": "HEALTH"})
    assert sorted((tuple(r) for r in joined.collect()), key=repr) == sorted((tuple(r) for r in made.collect()), key=repr)
    assert C.categorise(made.where("false").select("item"), "item", more).collect() == []


def test_record_errors(spark):
    box, rows = [0, 0, 5, 5], []
    rows += [(["a"], [box], [box], ["O"]), ([], [], [], []), (None, None, None, None), (["a", "b"], [box], [box, [0, 0, 5, 1001]], ["O", "B-X"]), (["a", "b"], [box, None], [box, [1, 2]], ["IGNORE", None])]
    made = C.record_errors(spark.createDataFrame(rows, "words array<string>, boxes array<array<int>>, normalized_boxes array<array<int>>, labels array<string>"), ["O"])
    assert [r["errors"] for r in made.collect()] == [[], ["no words"], ["no words"], ["unequal lengths", "unknown label at 1", "bad normalised box at 1"], ["unknown label at 1", "bad box at 1", "bad normalised box at 1"]]


def test_routes(spark):
    rows = [(1, "other", 0, None, "ITEM_NAME"), (1, "item", 1, "tax_amount", "ITEM_NAME"), (1, "item", 2, None, "ITEM_NAME"), (1, "payment", 0, None, None), (1, "summary", 0, None, "TOTAL_NAME")]
    made = C.route_decisions(spark.createDataFrame(rows, "doc_id int, source string, ordinal int, relation_type string, head_field string")).orderBy("relation_id").collect()
    assert [(r["source"], r["route"], r["edge_id"]) for r in made] == [("item", "summary", None), ("item", "item", "g_000000"), ("summary", "summary", None), ("payment", "payment", None), ("other", "item", "g_000001")]


def test_audit(spark):
    held = spark.createDataFrame([(1, "B-ITEM_NAME"), (1, None), (2, "ITEM_PRICE"), (3, "B-ITEM_UNIT_PRICE"), (4, "B-ITEM_NAME"), (4, "I-ITEM_PRICE")], "doc_id int, label string")
    related = spark.createDataFrame([(1,), (4,), (4,), (9,)], "doc_id int")
    got = {r["doc_id"]: (r["n_relations"], r["issues"]) for r in C.audit_labels(held, related).collect()}
    assert got == {1: (1, ["name without price"]), 2: (0, ["price without name", "no relations"]), 3: (0, ["no relations"]), 4: (2, [])}


def test_span_pool_mean_of_every_position(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r["label"]: r for r in QUERIES["span_pool_mean"](spark, SF).collect()}
    assert set(got) == {r["label"] for r in rows}
    for label, r in got.items():
        held = [x["embedding"] for x in rows if x["label"] == label]
        assert r["n"] == len(held) and r["vector"] == pytest.approx([sum(v) / len(held) for v in zip(*held, strict=True)], abs=1e-6)


def test_pool_modes(spark):
    from tillroll.operators import spans as B

    rows = [("a", 2, [1.0, 2.0]), ("a", 1, [3.0, 4.0, 5.0]), ("a", 3, None), ("a", 4, []), ("b", 1, None), (None, 1, [7.0])]
    df = spark.createDataFrame(rows, "k string, i int, v array<double>")
    got = lambda mode: {r["k"]: (r["vector"], r["n"]) for r in B.pool(df, "v", "i", "k", mode=mode).collect()}
    assert got("mean") == {"a": ([2.0, 3.0, 5.0], 4), "b": (None, 1), None: ([7.0], 1)}
    assert got("first") == {"a": ([3.0, 4.0, 5.0], 4), "b": (None, 1), None: ([7.0], 1)}
    with pytest.raises(ValueError):
        B.pool(df, "v", "i", "k", mode="last")


def test_models_best_first(spark):
    from tillroll.operators import metrics as M

    rows = [("a", "12.30", "12,30"), ("b", "12.30", "12.30"), ("b", "tea", "x"), ("c", "12.30", "99999"), ("d", "tea", "tea"), ("e", "12.30", "12.30"), ("e", "tea", "tea")]
    made = M.summarise_models(M.compare_tokens(spark.createDataFrame(rows, "model string, truth string, found string")))
    assert [r["model"] for r in made.collect()] == ["e", "b", "a", "c", "d"]


# Greedy operators against a plain reading of their rules.
def some_spans(seed, n=25):
    import numpy as np

    r, rows = np.random.default_rng(seed), []
    for d in range(n):
        for k in range(int(r.integers(0, 9))):
            x, y = int(r.integers(0, 300)), int(r.integers(0, 60))
            rows.append((d, k, str(r.choice(["ITEM_NAME", "ITEM_PRICE", "ITEM_QTY"])), f"t{k}", 3 * k, 3 * k + int(r.integers(0, 3)), x, y, x + int(r.integers(1, 60)), y + int(r.integers(1, 40))))
    return rows


SPANS = "doc_id bigint, span_id int, field string, text string, first_word int, last_word int, x0 int, y0 int, x1 int, y1 int"


def brute_nearest(head, candidates, right):
    tall = lambda s: max(1, s[9] - s[7])
    talls = sorted(map(tall, [head, *candidates]))
    reach = max(10.0, min(90.0, talls[len(talls) // 2] * 1.45))
    found = []
    for c in candidates:
        dx, dy = (c[6] + c[8]) / 2 - (head[6] + head[8]) / 2, abs((c[7] + c[9]) / 2 - (head[7] + head[9]) / 2)
        if dy <= reach and not (right and dx < -0.2 * tall(head)):
            found.append((dy * 10 + abs(dx) * 0.04 + (0 if dx >= 0 else 25), c[1]))
    return min(found)[1] if found else None


def test_nearest_by_brute_force(spark):
    from tillroll.operators import pairs as P

    rows = some_spans(3) + [(90, 0, "ITEM_NAME", "h", 0, 0, 100, 0, 120, 10), (90, 1, "ITEM_PRICE", "p", 1, 1, 85, 0, 125, 60), (91, 0, "ITEM_NAME", "h", 0, 0, 0, 0, 5, 5)]
    df = spark.createDataFrame(rows, SPANS).repartition(3)
    names, prices = df.where("field = 'ITEM_NAME'"), df.where("field = 'ITEM_PRICE'")
    of = lambda d, field: [r for r in rows if r[0] == d and r[2] == field]
    for right in (True, False):
        expected = {(r[0], r[1]): brute_nearest(r, of(r[0], "ITEM_PRICE"), right) for r in rows if r[2] == "ITEM_NAME"}
        got = {(r["doc_id"], r["span_id"]): r["c_span_id"] for r in P.nearest_same_row(names, prices, right).collect()}
        assert got == {k: v for k, v in expected.items() if v is not None}
    expected = {}
    for d in {r[0] for r in rows}:
        left = of(d, "ITEM_PRICE")
        for head in of(d, "ITEM_NAME"):
            best = brute_nearest(head, left, True) if left else None
            if best is not None:
                expected[d, head[1]] = best
                left = [c for c in left if c[1] != best]
    assert {(r["doc_id"], r["span_id"]): r["c_span_id"] for r in P.nearest_exclusive(names, prices).collect()} == expected


def test_group_keys_in_order(spark):
    from tillroll.operators import pairs as P
    import numpy as np

    rows, r, relations = some_spans(5), np.random.default_rng(6), []
    for d in range(25):
        for k in range(int(r.integers(0, 8))):
            side = lambda: sorted(map(int, r.integers(0, 24, int(r.integers(1, 5)))))
            relations.append((d, k, None if d % 2 and r.random() < 0.8 else f"g{int(r.integers(0, 4))}", str(r.choice(["ITEM_NAME", "ITEM_NAME", "menu.nm", "DATE"])), side(), str(r.choice(["ITEM_PRICE", "ITEM_PRICE", "ITEM_QTY", "STORE_NAME"])), side()))
    schema = "doc_id bigint, rel_idx int, group_id string, head_field string, head_words array<int>, dep_field string, dep_words array<int>"
    expected = {}
    for d, k, own, head_field, head, dep_field, dep in sorted(relations, key=lambda x: x[:2]):
        if head_field == "DATE" or dep_field == "STORE_NAME":
            continue
        met = []
        for words in (head, dep):
            share = [(len(set(words) & set(range(s[4], s[5] + 1))), -s[1]) for s in rows if s[0] == d]
            met.append(-max(share)[1] if share and max(share)[0] else None)
        if None not in met:
            key = own or expected.get((d, met[0])) or f"item_rel_{k:04d}"
            expected[d, met[0]] = expected[d, met[1]] = key
    got = P.group_keys(spark.createDataFrame(rows, SPANS), spark.createDataFrame(relations, schema)).collect()
    assert {(x["doc_id"], x["span_id"]): x["group_key"] for x in got} == {(s[0], s[1]): expected.get((s[0], s[1])) for s in rows}
    assert any(v.startswith("item_rel") for v in expected.values())


def test_relations_by_precedence(spark):
    from tillroll.operators import pairs as P

    rows = [(1, ["a"], None, ["b"], ["x"], ["y"]), (2, [], [], None, ["x"], ["y"]), (3, None, None, None, [], ["y", "z"]), (4, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, item_relations array<string>, summary_relations array<string>, payment_relations array<string>, relations array<string>, rel_g_edges array<string>")
    assert sorted(map(tuple, P.relation_list(df).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "x"), (3, 0, "y"), (3, 1, "z")]


def test_rows_and_relaxed_spans_by_brute_force(spark):
    from tillroll.operators import metrics as M
    from tillroll.operators import spans as B

    rows = some_spans(7)
    words = spark.createDataFrame([(r[0], r[1], r[6], r[7], r[9]) for r in rows], "doc_id bigint, word_idx int, x0 int, y0 int, y1 int").repartition(3)
    expected = {}
    for d in {r[0] for r in rows}:
        page = [r for r in rows if r[0] == d]
        talls = sorted(max(1, r[9] - r[7]) for r in page)
        near, found = max(8.0, 0.65 * talls[len(talls) // 2]), []
        for w in sorted(page, key=lambda r: ((r[7] + r[9]) / 2, r[6], r[1])):
            middle = (w[7] + w[9]) / 2
            row = next((x for x in found if abs(sum(x[0]) / len(x[0]) - middle) <= near), None)
            if row is None:
                found.append(row := ([], len(found)))
            row[0].append(middle)
            expected[d, w[1]] = row[1]
    assert {(r["doc_id"], r["word_idx"]): r["row_id"] for r in B.row_clusters(words).collect()} == expected
    other = some_spans(8)
    counts = {}
    for field in ("ITEM_NAME", "ITEM_PRICE", "ITEM_QTY"):
        tp = fp = fn = 0
        for d in range(25):
            left = [(r[4], r[5]) for r in sorted(rows, key=lambda r: r[4:6]) if (r[0], r[2]) == (d, field)]
            for p in sorted((r[4], r[5]) for r in other if (r[0], r[2]) == (d, field)):
                hit = next((g for g in left if g[0] <= p[1] and p[0] <= g[1]), None)
                tp, fp = tp + (hit is not None), fp + (hit is None)
                if hit:
                    left.remove(hit)
            fn += len(left)
        counts[field] = (tp, fp, fn)
    made = M.relaxed_span_metrics(spark.createDataFrame(rows, SPANS), spark.createDataFrame(other, SPANS)).collect()
    assert {r["field"]: (r["tp"], r["fp"], r["fn"]) for r in made} == counts


def test_tail_and_cover(spark):
    from tillroll.operators import splits as Z

    df = spark.range(0, 50_000, 3).select(F.col("id"), (F.col("id") % 7).alias("label"), F.when(F.col("id") % 1000 == 0, "validation").otherwise("train").alias("split"))
    ids = [3 * k for k in range(16667)]
    for ratio in (0.0, 0.001, 0.15, 0.5, 0.9999):
        take = min(max(round(len(ids) * ratio), 1), len(ids) - 1)
        got = Z.tail_split(df.select("id"), "id", ratio).where("split = 'validation'").agg(F.min("id"), F.count("*")).first()
        assert tuple(got) == (ids[-take], take)
    moved = Z.cover_labels(df, "label", "split", 9, "id")
    assert moved.columns == df.columns and moved.count() == len(ids)
    assert {r["count"] for r in moved.where("split = 'validation'").groupBy("label").count().collect()} == {9}


def test_skipped_items(spark):
    from tillroll.operators import preparation as W

    boxes = [[0.5, 1.5, 2.5, 3.5], [1.0, 1.0, 1.0, 2.0], None, [1.0, 2.0, 3.0], [None, 1.0, 2.0, 3.0], [5e12, 1.0, 2.0, 3.0], [200.0, 1.0, 300.0, 3.0], [-5.0, -5.0, 2.0, 2.0], [1.6, 1.0, 2.4, 9.0], [1.0, 1.0, 99.0, 120.0]]
    rows = [(1, i, "\x0b" if i == 7 else f" a{i}\t", b, 100, 100) for i, b in enumerate(boxes)] + [(2, 0, None, boxes[0], 100, 100), (2, 1, "\u00a0", boxes[0], None, 100), (2, 2, "b", boxes[0], 2000, 100), (2, 3, "c", boxes[0], 0, 100)]
    made = W.prepare_words(spark.createDataFrame(rows, "doc_id bigint, raw_index int, text string, box array<double>, page_w int, page_h int"))
    got = {(r["doc_id"], r["raw_index"]): r for r in made.collect()}
    bad, after = "invalid_box", "invalid_box_after_clamp"
    assert [got[1, i]["skipped"] for i in range(10)] == [None, bad, bad, bad, bad, bad, after, "empty_text", after, None]
    assert [got[2, i]["skipped"] for i in range(4)] == ["empty_text", after, None, after]
    assert (got[1, 0]["pixel"], got[1, 0]["thousandth"], got[1, 0]["text"], got[1, 9]["word_idx"]) == ([0, 2, 2, 4], [0, 20, 20, 40], "a0", 1)
    assert (got[1, 9]["pixel"], got[2, 1]["pixel"], got[2, 1]["thousandth"]) == ([1, 1, 99, 99], [0, 2, 2, 4], None)
    counts = {r["doc_id"]: tuple(r)[1:] for r in W.skip_counts(made).collect()}
    assert counts == {1: (10, 2, 1, 7, False, False), 2: (4, 1, 1, 2, False, True)}


def test_counts_of_skipped_words_round_each_side_once_and_make_no_pixels(spark):
    plan = QUERIES["skipped_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "bround" not in plan and "regexp_replace" not in plan and plan.count("rint(") == 4
