"""The queries of this package, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelplan.llm.bpe import bpe_round_trip
from panelplan.llm.common import table
from panelplan.llm.decontaminate import benchmark_hits
from panelplan.llm.divergence import source_divergence
from panelplan.llm.language import id_fold, identify_language, reference_texts
from panelplan.llm.neighbours import nearest_neighbours
from panelplan.llm.periodic import longest_run, periodic_runs, planted
from panelplan.llm.quality import judge_quality
from panelplan.llm.repeats import repeats_removed
from panelplan.llm.simhash import simhash_components
from panelplan.llm.token_files import token_file_digests
from panelplan.llm.toxicity import score_toxicity, train_toxicity
from panelplan.llm.url_filter import filter_urls
from panelplan.llm.warc import warc_round_trip


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels, usable=id_fold(F.col("id"), 5) != 0)
    held_out = F.coalesce(id_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "spans")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    references = reference_texts(docs.filter(id_fold(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(id_fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify_language(docs, references).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"), with_bytes=True)
    removed = (F.col("n_bytes") - F.octet_length("kept_bytes")).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("starts").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), F.col("kept").alias("text"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = longest_run(periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_language": op3_language,
    "op4_repeats": op4_repeats,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_neighbours": op8_neighbours,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_quality_rules": op12_quality_rules,
    "op13_periodic_runs": op13_periodic_runs,
}

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\x{{80}}-\x{{10FFFF}}]+')"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

ORACLE = {
    "op6_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN f USING (d)""",
    "op9_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS p
                FROM (SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        dp AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, i, k, item FROM dp JOIN win USING (k, p)),
        pos AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT doc_id, i, unnest(range(0, k)) AS o FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op11_source_divergence": f"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
        t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
        gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
        ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
        p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS BIGINT) AS p
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN gn USING (lang, source)),
        q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (total + v) AS BIGINT) AS q
              FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang) JOIN ln USING (lang)),
        pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
                 FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
                  UNION ALL
                  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
        WHERE part = 'pair' OR rank <= 200""",
}
