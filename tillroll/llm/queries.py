"""The queries of this subpackage, a thin one for each operator over the whole of its tables, and SQL where it can say as much."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import classifier, decontaminate, mixing, pii, quality, secrets, simhash, substrings, tokens, toxicity
from tillroll.session import ship, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_report(table(ship(spark), sf_dir, "documents"))


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(ship(spark), sf_dir, "documents"))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(ship(spark), sf_dir, "documents"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(ship(spark), sf_dir, "documents"))


def op6_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(table(ship(spark), sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(ship(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_personal_data, op3_poisson_mix, op4_quality_ledger, op5_token_shards, op6_quality_attention, op7_substring_dedup, op8_decontaminate, op9_toxic_segments, op10_secret_automaton)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_MASK = sum(1 << k for k, name in enumerate(quality.RULES) if name in quality.POLICIES[quality.CURRENT])

ORACLE_SQL = {
    "op3_poisson_mix": f"""
        WITH RECURSIVE sized AS (
            SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {mixing.TEMPER}) AS share FROM documents GROUP BY source
        ), rated AS (
            SELECT source, (SELECT sum(n) FROM sized)::DOUBLE * share / (SELECT sum(share) FROM sized) / n AS whole FROM sized
        ), split AS (
            SELECT source, greatest(1, ceil(whole / {mixing.STEP}))::BIGINT AS streams, whole / greatest(1, ceil(whole / {mixing.STEP})) AS rate FROM rated
        ), chance AS (
            SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM split
            UNION ALL
            SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM chance WHERE k < {mixing.TERMS - 1}
        ), drawn AS (
            SELECT d.*, s.stream, ('0x' || substr(md5('{mixing.SEED}:' || s.stream || ':' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(md5(text), '~')), 1, 13))::BIGINT / {float(1 << 52)} AS u
            FROM documents d JOIN (SELECT source, unnest(generate_series(0, streams - 1)) AS stream FROM split) s ON d.source IS NOT DISTINCT FROM s.source
        ), copies AS (
            SELECT doc_id, text, lang, d.source, n_chars, count_if(c.cdf <= u)::BIGINT AS n
            FROM drawn d JOIN chance c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
        )
        SELECT doc_id, text, lang, source, n_chars FROM copies, unnest(generate_series(1, n)) AS x(copy)
    """,
    "op4_quality_ledger": rf"""
        WITH worded AS (
            SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), places AS (
            SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS five FROM worded, unnest(generate_series(1, len(words) - 4)) AS x(i)
        ), again AS (
            SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
        ), repeated AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(generate_series(0, 4)) AS x(k) GROUP BY doc_id
        ), measured AS (
            SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines,
                   length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
            FROM worded w LEFT JOIN repeated r ON w.doc_id = r.doc_id
        ), judged AS (
            SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, rule in enumerate(quality.RULES.values()))})::BIGINT AS failures FROM measured
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures & {_MASK | 3} = 0 AS kept, failures FROM judged
    """,
    "op7_substring_dedup": rf"""
        WITH worded AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        later AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS w FROM worded, unnest(generate_series(1, len(words) - 19)) AS x(i))
            QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1
        ), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, unnest(generate_series(0, 19)) AS x(k)),
        kept AS (
            SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS text, count(*) AS n
            FROM (SELECT doc_id, i, words[i] AS word FROM worded, unnest(generate_series(1, len(words))) AS x(i)) a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i
            GROUP BY a.doc_id
        )
        SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
        FROM worded w LEFT JOIN kept k ON w.doc_id = k.doc_id
    """,
    "op8_decontaminate": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        wanted AS (SELECT DISTINCT item_id, least(13, len(words)) AS n, array_to_string(words[i : i + 12], ' ') AS w FROM items, unnest(generate_series(1, greatest(1, len(words) - 12))) AS x(i) WHERE len(words) > 0),
        there AS (SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS w FROM docs, (SELECT DISTINCT n FROM wanted), unnest(generate_series(1, len(words) - n + 1)) AS x(i)),
        found AS (SELECT doc_id, item_id, i, t.n FROM there t JOIN wanted USING (n, w)),
        hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(generate_series(0, n - 1)) AS x(k) GROUP BY doc_id),
        of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
        FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)
    """,
}
