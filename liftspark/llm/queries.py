"""Registered queries of this package, each over a whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .kneser_ney import lm_score
from .language_id import language_id
from .license_scan import license_scan
from .line_dedup import line_classes
from .ngram_join import ngram_join
from .secret_scan import secret_scan
from .url_filter import RULES, rule_table, url_filter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_read(spark, sf_dir, "documents"), ranks_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(_read(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"), keep="max")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"), rule_table(spark, RULES))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_dedup": op3_line_dedup,
    "op4_lm_score": op4_lm_score,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op9_language_id": op9_language_id,
    "op8_url_filter": op8_url_filter,
    "op10_decontamination": op10_decontamination,
}

#: Lower-cased A-Z alone, and words of all characters but space and U+0009-000D.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
        t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
        reach AS (SELECT doc_id, doc_id AS b FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text
    """,
    "op8_url_filter": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
        b AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, h, p)),
        m AS (SELECT b.page_id, r.h || r.p AS rule, r.verdict,
                     row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.verdict DESC) AS k
              FROM b JOIN r ON (b.host = r.h OR ends_with(b.host, '.' || r.h)) AND starts_with(b.path, r.p))
        SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM b LEFT JOIN m ON b.page_id = m.page_id AND m.k = 1
    """,
}
