"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as s
from ..functions import text as t
from ..operators.table import Table
from ..ops import select, where, with_column, with_columns
from ..sources import io
from ..sources.io import read_parquet
from ..unicode_tables import WHITE_CLASS
from . import text_pipeline as fw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Source:
    """Tables of a folder, read when named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, table: str) -> DataFrame:
        return read_parquet(self.spark, f"{self.folder}/{table}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Source], DataFrame | Table]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Source(spark, sf_dir))
            return out.df if isinstance(out, Table) else out

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


c = F.col
LINE = ("l_orderkey", "l_linenumber")
LI = "SELECT l_orderkey, l_linenumber, "


def _line(name: str, column: str, build, sql: str) -> None:
    """A query that adds one computed column to the key of lineitem."""
    query(name, f"{LI}{sql} AS {column} FROM lineitem")(lambda d: select(d.lineitem, *LINE, **{column: build()}))


_line("affine_f64", "y", lambda: s.affine(c("l_quantity")), "l_quantity * 2.0 + 3.0")
_line("op_add", "y", lambda: s.add(c("l_quantity"), c("l_tax")), "l_quantity + l_tax")
_line("op_sub", "y", lambda: s.subtract(c("l_extendedprice"), c("l_quantity")), "l_extendedprice - l_quantity")
_line("op_mul", "y", lambda: s.multiply(c("l_extendedprice"), c("l_discount")), "l_extendedprice * l_discount")
_line("op_truediv", "y", lambda: s.divide(c("l_extendedprice"), c("l_quantity")), "l_extendedprice / l_quantity")
_line("op_truediv_int", "y", lambda: s.divide_int(c("l_orderkey"), c("l_linenumber")), "l_orderkey::DOUBLE / l_linenumber::DOUBLE")
_line("op_add_int", "y", lambda: s.add_int(c("l_orderkey"), c("l_partkey")), "l_orderkey + l_partkey * 2 - 1")
_line("op_select", "y", lambda: s.pick(c("l_quantity"), c("l_discount") * 400), "CASE WHEN l_quantity > l_discount * 400 THEN l_quantity ELSE l_discount * 400 END")
_line("op_constant", "y", lambda: s.constant(c("l_quantity")), "'fixed'")
_line("udf_branch", "y", lambda: s.tiered(c("l_extendedprice")), "CASE WHEN l_extendedprice > 50000 THEN l_extendedprice * 0.9::DOUBLE WHEN l_extendedprice > 20000 THEN l_extendedprice * 0.95::DOUBLE ELSE l_extendedprice END")
_line("numeric_udf", "y", lambda: s.revenue(c("l_extendedprice"), c("l_quantity"), c("l_tax")), "l_extendedprice * l_quantity * (1.0::DOUBLE + l_tax)")
_line("branch_udf", "y", lambda: s.discounted(c("l_extendedprice"), 30000.0), "CASE WHEN l_extendedprice > 30000 THEN l_extendedprice * 0.9::DOUBLE ELSE l_extendedprice END")
_line("nullable_udf", "y", lambda: s.raised(F.nullif(c("l_quantity"), F.lit(1.0))), "nullif(l_quantity, 1.0) * 1.1::DOUBLE")
_line("score_nullable", "y", lambda: s.score(F.nullif(c("l_extendedprice"), F.lit(0.0)), F.nullif(c("l_quantity"), F.lit(2.0)), c("l_tax")), "nullif(l_extendedprice, 0.0) * nullif(l_quantity, 2.0) + l_tax")
_line("op_is_null", "y", lambda: s.is_missing(F.nullif(c("l_quantity"), F.lit(1.0))), "nullif(l_quantity, 1.0) IS NULL")
_line("float32_round", "y", lambda: s.single(c("l_quantity")), "(l_quantity * 1.1::DOUBLE)::FLOAT")
_line("wrapped_udf", "y", lambda: s.wrapped_affine(c("l_quantity")), "l_quantity * 1.5 + 1.25")
_line("fallback_opaque", "y", lambda: s.rounded(c("l_quantity")), "floor(l_quantity * 1.5 + 1.25)::DOUBLE")
_line("batch_lift", "y", lambda: s.batched_root(c("l_quantity")), "sqrt(l_quantity)")
_line("fn_abs", "y", lambda: s.absolute(c("l_discount") - 0.05), "abs(l_discount - 0.05::DOUBLE)")


@query("op_compare", LI + "l_quantity = l_tax * 100 AS eq, l_quantity <> l_tax * 100 AS ne, l_quantity < l_tax * 100 AS lt, l_quantity <= l_tax * 100 AS le, l_quantity > l_tax * 100 AS gt, l_quantity >= l_tax * 100 AS ge FROM lineitem")
def _(d):
    a, b = c("l_quantity"), c("l_tax") * 100
    return select(d.lineitem, *LINE, eq=s.equal(a, b), ne=s.not_equal(a, b), lt=s.less(a, b), le=s.less_or_equal(a, b), gt=s.greater(a, b), ge=s.greater_or_equal(a, b))


@query("op_cast", LI + "trunc(l_extendedprice)::BIGINT AS i, l_orderkey::VARCHAR AS t, l_orderkey::DOUBLE AS f, l_discount <> 0 AS b FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, i=s.truncated(c("l_extendedprice")), t=s.digits(c("l_orderkey")), f=s.widened(c("l_orderkey")), b=s.truthy(c("l_discount")))


@query("nan_compare", LI + "NOT isnan(x) AND x > 1.0 AS above, isnan(x) AS odd FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_quantity - 20 END AS x FROM lineitem)")
def _(d):
    df = d.lineitem.withColumn("x", F.when(c("l_linenumber") == 1, F.lit(float("nan"))).otherwise(c("l_quantity") - 20))
    return select(df, *LINE, above=s.above_one(c("x")), odd=s.differs_from_itself(c("x")))


@query("where_udf_predicate", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity * 2.0 + 3.0 >= 60 AND l_quantity >= 2.0")
def _(d):
    return where(d.lineitem.select(*LINE, "l_quantity"), (s.affine(c("l_quantity")) >= 60.0) & s.at_least_two(c("l_quantity")))


@query("select_udf_projection", "SELECT l_orderkey, l_quantity + 10.0 AS ten, l_quantity * 2.0 + 3.0 AS affine FROM lineitem")
def _(d):
    return select(d.lineitem, "l_orderkey", s.affine(c("l_quantity")), ten=s.plus_ten(c("l_quantity")))


@query("with_columns_udf", "SELECT l_orderkey, l_linenumber, l_quantity, l_quantity * 2.0 + 3.0 AS a, l_quantity + 10.0 AS b FROM lineitem")
def _(d):
    return with_columns(d.lineitem.select(*LINE, "l_quantity"), {"a": s.affine(c("l_quantity")), "b": s.plus_ten(c("l_quantity"))})


@query("with_column_udf", "SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + 3.0 AS l_quantity FROM lineitem")
def _(d):
    return with_column(d.lineitem.select(*LINE, "l_quantity"), "l_quantity", s.affine(c("l_quantity")))


@query("nested_udf_expr", LI + "(l_quantity * 2.0 + 3.0 + 1.0) * 0.5 AS x FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, ((s.affine(c("l_quantity")) + 1.0) * 0.5).alias("x"))


@query("nested_calls", LI + "(l_quantity + 10.0) * 2.0 + 3.0 AS x FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, x=s.affine(s.plus_ten(c("l_quantity"))))


@query("multi_udf_chain", "SELECT l_orderkey, l_linenumber, l_quantity * 2.0 + 3.0 AS projected, l_quantity + 10.0 AS selected FROM lineitem WHERE l_quantity >= 2.0")
def _(d):
    df = with_columns(d.lineitem, {"projected": s.affine(c("l_quantity"))})
    return select(where(df, s.at_least_two(c("l_quantity"))), *LINE, "projected", selected=s.plus_ten(c("l_quantity")))


@query("zero_row", "SELECT l_orderkey, l_quantity * 2.0 + 3.0 AS y FROM lineitem WHERE l_quantity < 0")
def _(d):
    return select(d.lineitem.where("l_quantity < 0"), "l_orderkey", y=s.affine(c("l_quantity")))


@query("q6_udf_predicate", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05::DOUBLE AND 0.07::DOUBLE AND l_quantity < 24")
def _(d):
    df = where(d.lineitem.where("l_shipdate >= TIMESTAMP_NTZ '1994-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01'"), s.promising(c("l_quantity"), c("l_discount")))
    return df.agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")), 2).alias("revenue"))


@query("op_tuple", "SELECT l_orderkey, l_linenumber, l_partkey AS _1, l_tax AS _2 FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, pair=s.both(c("l_partkey"), c("l_tax"))).select(*LINE, "pair.*")


@query("op_list", LI + "[l_tax, l_discount] AS y FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, y=s.listed(c("l_tax"), c("l_discount")))


@query("op_field_load", LI + "l_extendedprice * 0.9::DOUBLE AS y FROM lineitem")
def _(d):
    df = d.lineitem.select(*LINE, F.struct(c("l_extendedprice").alias("price"), "l_tax").alias("row"))
    return select(df, *LINE, y=s.field_price(c("row")))


# text

DOC = "SELECT doc_id, "
_SQL_CLASS = {"alnum": r"[^\p{L}\p{N}]+", "alpha": r"[^\p{L}]+", "decimal": r"[^\p{Nd}]+", "digit": r"[^\p{Nd}]+", "numeric": r"[^\p{N}]+"}


def _sql_count(name: str, text: str = "text") -> str:
    pattern = rf"[^{WHITE_CLASS}]+" if name == "space" else _SQL_CLASS[name]
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


def _doc(name: str, column: str, build, sql: str, source: str = "documents", key: str = "doc_id") -> None:
    query(name, f"SELECT {key}, {sql} AS {column} FROM {source}")(lambda d: select(getattr(d, source), key, **{column: build()}))


for _name in ("alnum", "alpha", "decimal", "digit", "numeric", "space"):
    _doc(f"prop_{_name}", "n", lambda f=getattr(s, f"count_{_name}"): f(c("text")), f"{_sql_count(_name)}::BIGINT")
_doc("loop_count_gen", "n", lambda: s.count_alnum(c("text")), f"{_sql_count('alnum')}::BIGINT")
_doc("loop_count_for", "n", lambda: s.count_alnum_loop(c("text")), f"{_sql_count('alnum')}::BIGINT")
_doc("alnum_ratio", "r", lambda: t.alnum_ratio(c("text")), f"CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE {_sql_count('alnum')}::DOUBLE / length(text)::DOUBLE END")
_doc("fn_len", "n", lambda: s.length(c("text")), "length(text)::BIGINT")
_doc("fn_lower", "x", lambda: s.lowered(c("text")), "lower(text)")
_doc("fn_upper", "x", lambda: s.uppered(c("source")), "upper(source)")
_doc("fn_startswith", "x", lambda: s.starts(c("text")), "starts_with(text, 'The')")
_doc("fn_endswith", "x", lambda: s.ends(c("text")), "ends_with(text, '.')")
_doc("op_concat", "x", lambda: s.joined(c("lang"), c("source")), "lang || '/' || source")
_NOISY = "concat('“', text, '”  —…\t', lang, '™ ')"
_FROM, _TO = "".join(t.PUNCTUATION), "".join(t.PUNCTUATION.values()).replace("'", "''")


def _noisy(d):
    return d.documents.select("doc_id", F.concat(F.lit("“"), "text", F.lit("”  —…\t"), "lang", F.lit("™ ")).alias("text"))


@query("punct_normalize", f"SELECT doc_id, translate({_NOISY}, '{_FROM}', '{_TO}') AS x FROM documents")
def _(d):
    return select(_noisy(d), "doc_id", x=t.normalize_punctuation(c("text")))


@query("punct_expand", f"SELECT doc_id, replace(replace(replace(replace({_NOISY}, '…', '...'), '–', ' - '), '—', ' - '), '™', '') AS x FROM documents")
def _(d):
    return select(_noisy(d), "doc_id", x=t.expand_punctuation(c("text")))


@query("ws_normalize", f"SELECT doc_id, trim(regexp_replace({_NOISY}, '[{WHITE_CLASS}]+', ' ', 'g')) AS x FROM documents")
def _(d):
    return select(_noisy(d), "doc_id", x=t.normalize_space(c("text")))


@query("ws_normalize_emspace", f"SELECT doc_id, trim(regexp_replace({_NOISY}, '[{WHITE_CLASS}]+', ' ', 'g'), ' ') AS x FROM documents")
def _(d):
    return select(_noisy(d), "doc_id", x=t.normalize_space_em(c("text")))


_doc("html_strip", "x", lambda: t.strip_tags(c("html")), "regexp_replace(html, '<[^>]+>', ' ', 'g')", "pages", "page_id")


@query("text_length_filter", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) BETWEEN 200 AND 20000")
def _(d):
    return select(where(d.documents, t.length_between(c("text"))), "doc_id", n=s.length(c("text")))


@query("alnum_ratio_filter", f"SELECT doc_id FROM documents WHERE length(text) > 0 AND {_sql_count('alnum')}::DOUBLE / length(text)::DOUBLE >= 0.72::DOUBLE")
def _(d):
    return select(where(d.documents.where("length(text) > 0"), t.alnum_at_least(c("text"))), "doc_id")


@query("alnum_ratio_guarded", f"SELECT doc_id FROM documents WHERE CASE WHEN length(text) = 0 THEN FALSE ELSE {_sql_count('alnum')}::DOUBLE / length(text)::DOUBLE >= 0.72::DOUBLE END")
def _(d):
    return select(where(d.documents, t.alnum_at_least_or_empty(c("text"))), "doc_id")


@query("sentence_split_join", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10))), lambda x: x <> ''), '|') AS x FROM documents")
def _(d):
    pieces = F.transform(F.split("text", r"(?<=[.!?])[ \t\n]+"), lambda x: F.btrim(x, F.lit(" \t\n")))
    return d.documents.select("doc_id", F.array_join(F.filter(pieces, lambda x: x != ""), "|").alias("x"))


# arrays

_vec = "SELECT vec_id, "
_vector_sum = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6)"


@query("loop_sum_gen", f"{_vec}{_vector_sum} AS y FROM embeddings")
def _(d):
    return select(d.embeddings, "vec_id", y=s.sum_all(c("embedding"))).withColumn("y", F.round("y", 6))


@query("loop_sum_for", f"{_vec}{_vector_sum} AS y FROM embeddings")
def _(d):
    return select(d.embeddings, "vec_id", y=s.sum_loop(c("embedding"))).withColumn("y", F.round("y", 6))


@query("loop_seeded", f"{_vec}round(1.5 + coalesce(list_sum(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)), 0), 6) AS y FROM embeddings")
def _(d):
    return select(d.embeddings, "vec_id", y=s.sum_seeded(c("embedding"))).withColumn("y", F.round("y", 6))


@query("loop_pred_cmp", f"{_vec}len(list_filter(embedding, lambda x: x > 0))::BIGINT AS y FROM embeddings")
def _(d):
    return select(d.embeddings, "vec_id", y=s.count_positive(c("embedding")))


@query("loop_mean", f"{_vec}round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 6) AS y FROM embeddings")
def _(d):
    return select(d.embeddings, "vec_id", y=s.mean_of(c("embedding"))).withColumn("y", F.round("y", 6))


# batches, caches

EV = "SELECT event_id, "
_K = "regexp_extract(props, ': *([0-9]+)', 1)"


@query("dict_domain", f"{EV}{_K} AS k FROM events")
def _(d):
    return select(d.events, "event_id", k=s.value_of_k(c("props")))


@query("lookup_json", "SELECT l_orderkey, l_linenumber, '{\"flag\":\"' || l_returnflag || '\",\"meaning\":\"' || CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'new' ELSE 'returned' END || '\"}' AS y FROM lineitem")
def _(d):
    table = d.spark.createDataFrame(list(s.REGIONS.items()), "flag string, meaning string")
    joined = d.lineitem.join(F.broadcast(table), c("l_returnflag") == c("flag"), "left")
    return joined.select(*LINE, F.to_json(F.struct("flag", "meaning")).alias("y"))


@query("lookup_udf", LI + "CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'new' ELSE 'returned' END AS y FROM lineitem")
def _(d):
    return select(d.lineitem, *LINE, y=s.meaning(c("l_returnflag")))


@query("json_index", f"{EV}{_K}::BIGINT AS k FROM events")
def _(d):
    return d.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("invariant_hoist", f"{EV}'run-v1/' || event_type AS y FROM events")
def _(d):
    return select(d.events, "event_id", y=s.labelled(c("event_type")))


@query("op_isin", f"{EV}event_type IN ('click', 'view') AS y FROM events")
def _(d):
    return select(d.events, "event_id", y=s.known_type(c("event_type")))


# the text pipeline, stage by stage

_PAGES_NOISY = "concat(html, ' see https://a.example/x?y=1 or mail a.b@c.example now\nCopyright 2020 Someone\nend')"


def _pages(d):
    return d.pages.select(c("page_id").alias("doc_id"), F.concat("html", F.lit(" see https://a.example/x?y=1 or mail a.b@c.example now\nCopyright 2020 Someone\nend")).alias("text"))


_STAGE_SQL = {
    "clean_html": f"regexp_replace({_PAGES_NOISY}, '<[^>]+>', ' ', 'g')",
    "clean_links": f"regexp_replace({_PAGES_NOISY}, '{fw.LINKS}', '', 'g')",
    "clean_email": f"regexp_replace({_PAGES_NOISY}, '{fw.EMAIL}', '', 'g')",
    "clean_copyright": f"regexp_replace({_PAGES_NOISY}, '{fw.COPYRIGHT}', '', 'g')",
    "fix_unicode": f"nfc_normalize({_PAGES_NOISY})",
}
for _name, _sql in _STAGE_SQL.items():
    query(f"fw_{_name}", f"SELECT page_id AS doc_id, {_sql} AS text FROM pages")(lambda d, f=getattr(fw, _name): f(_pages(d)))

_LANG = ", ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in fw.FUNCTION_WORDS.values())
_REPEAT = "len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' '))::DOUBLE"


@query("fw_lang_score", f"SELECT doc_id, greatest({_LANG})::BIGINT AS score FROM documents")
def _(d):
    return d.documents.select("doc_id", fw.language_score(F.lower("text")).cast("long").alias("score"))


@query("fw_perplexity_proxy", f"SELECT doc_id, {_REPEAT} AS score FROM documents")
def _(d):
    return d.documents.select("doc_id", fw.repetition(c("text")).alias("score"))


@query("fw_dedup", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(d):
    return fw.dedup(d.documents.select("doc_id", "text"))


@query("fw_text_chunk", "SELECT doc_id, (i - 1)::INTEGER AS chunk_no, string_split(text, '. ')[i] AS chunk FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM documents)")
def _(d):
    return fw.chunk(d.documents.select("doc_id", "text"))


_CLEAN = f"trim(regexp_replace(translate(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{fw.LINKS}', '', 'g'), '{fw.EMAIL}', '', 'g'), '{fw.COPYRIGHT}', '', 'g')), '{_FROM}', '{_TO}'), '[{WHITE_CLASS}]+', ' ', 'g'))"
_PIPELINE = f"""
    WITH a AS (SELECT doc_id, {_CLEAN} AS text FROM documents),
    b AS (SELECT * FROM a WHERE length(text) BETWEEN 200 AND 20000 AND {_sql_count('alnum')}::DOUBLE / length(text)::DOUBLE >= 0.2::DOUBLE
          AND greatest({_LANG}) >= 1 AND {_REPEAT} >= 0.1::DOUBLE),
    e AS (SELECT min(doc_id) AS doc_id, text FROM b GROUP BY text),
    f AS (SELECT doc_id, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS i FROM e)
    SELECT doc_id, (i - 1)::INTEGER AS chunk_no, string_split(text, '. ')[i] AS chunk FROM f"""


@query("fw_pipeline", _PIPELINE)
def _(d):
    return fw.text_pipeline(d.documents.select("doc_id", "text"))


# the relational surface

def table(name: str, sql: str | None = None):
    def register(fn):
        return query(name, sql)(lambda d: fn(lambda n: Table(getattr(d, n))))

    return register


@table("agg", "SELECT count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, max(l_tax) AS t FROM lineitem")
def _(T):
    return T("lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.max("l_tax").alias("t"))


@table("agg_udf", "SELECT round(sum(l_quantity * 2.0 + 3.0), 2) AS y FROM lineitem")
def _(T):
    return T("lineitem").with_column("y", s.affine(c("l_quantity"))).agg(F.round(F.sum("y"), 2).alias("y"))


@table("agg_list", "SELECT list_sort(list(n_nationkey)) AS n_nationkey FROM nation")
def _(T):
    return T("nation").agg_list("n_nationkey").with_column("n_nationkey", F.sort_array("n_nationkey"))


@table("agg_set", "SELECT list_sort(list(DISTINCT n_regionkey)) AS n_regionkey FROM nation")
def _(T):
    return T("nation").agg_set("n_regionkey").with_column("n_regionkey", F.sort_array("n_regionkey"))


@table("agg_concat", "SELECT list_sort(flatten(list([n_nationkey, n_regionkey]))) AS x FROM nation")
def _(T):
    return T("nation").select(x=F.array("n_nationkey", "n_regionkey")).agg_concat("x").with_column("x", F.sort_array("x"))


@table("any_value", "SELECT any_value(left(n_name, 0) || 'one') AS x FROM nation")
def _(T):
    return T("nation").select(x=F.concat(F.left("n_name", F.lit(0)), F.lit("one"))).any_value("x")  # one value, so that any of them is that


@table("count", "SELECT count(o_orderkey)::BIGINT AS o_orderkey FROM orders")
def _(T):
    return T("orders").count("o_orderkey")


@table("min_max_mean_sum_stddev", "SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, round(stddev_pop(o_totalprice), 4) AS dev FROM orders")
def _(T):
    x = "o_totalprice"
    return T("orders").agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.round(F.mean(x), 4).alias("mean"), F.round(F.sum(x), 2).alias("total"), F.round(F.stddev_pop(x), 4).alias("dev"))


@table("describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(\"column\", type)")
def _(T):
    return T("region").describe()


@table("summarize", "SELECT 'n_nationkey' AS \"column\", min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max, count(*)::BIGINT AS count FROM nation UNION ALL SELECT 'n_name', min(n_name), max(n_name), count(*)::BIGINT FROM nation UNION ALL SELECT 'n_regionkey', min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR, count(*)::BIGINT FROM nation")
def _(T):
    return T("nation").summarize().select("column", "min", "max", "count")


@table("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(T):
    return T("orders").select("o_orderstatus", "o_orderpriority").distinct()


@table("drop_nan", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 1")
def _(T):
    return T("lineitem").with_column("x", F.when(c("l_linenumber") == 1, F.lit(float("nan"))).otherwise(c("l_tax"))).drop_nan("x").select(*LINE)


@table("drop_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <> 1")
def _(T):
    return T("lineitem").with_column("x", F.nullif(c("l_quantity"), F.lit(1.0))).drop_null("x").select(*LINE)


@table("exclude", "SELECT r_regionkey FROM region")
def _(T):
    return T("region").exclude("r_name")


@table("getitem", "SELECT r_name FROM region")
def _(T):
    return T("region")[["r_name"]]


@table("explode", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def _(T):
    return T("embeddings").select("vec_id", "embedding").explode("embedding")


@table("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def _(T):
    return T("orders").select("o_orderkey", "o_totalprice").sort("o_orderkey").limit(60).offset(10)


@table("into_batches_partitions", "SELECT o_orderkey FROM orders")
def _(T):
    return T("orders").select("o_orderkey").into_batches(10000).into_partitions(4).repartition(4, "o_orderkey")


@table("unpivot", "SELECT o_orderkey, 'o_custkey' AS variable, o_custkey AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderkey2', o_orderkey FROM orders")
def _(T):
    return T("orders").select("o_orderkey", "o_custkey", o_orderkey2=c("o_orderkey")).unpivot(["o_orderkey"], ["o_custkey", "o_orderkey2"])


@table("pivot", "SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 2) AS a, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 2) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 2) AS r FROM lineitem GROUP BY l_linestatus")
def _(T):
    return T("lineitem").pivot(["l_linestatus"], "l_returnflag", "l_quantity", "sum", ["A", "N", "R"]).select("l_linestatus", a=F.round("A", 2), n=F.round("N", 2), r=F.round("R", 2))


@table("sample")
def _(T):
    return T("orders").sample(0.1, seed=7).select("o_orderkey")


@table("sort", "SELECT c_custkey, c_acctbal FROM customer")
def _(T):
    return T("customer").select("c_custkey", "c_acctbal").sort("c_acctbal", "c_custkey", desc=[True, False])


@table("rename", "SELECT r_regionkey AS k, r_name AS n FROM region")
def _(T):
    return T("region").with_column_renamed("r_regionkey", "k").with_columns_renamed({"r_name": "n"})


@table("groupby", "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity * 2.0 + 3.0), 2) AS y FROM lineitem GROUP BY 1, 2")
def _(T):
    return T("lineitem").with_column("y", s.affine(c("l_quantity"))).groupby("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


_JOINS = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}


def _customers(T):
    return Table(T("customer").df.select("c_custkey", "c_mktsegment"))


def _orders(T):
    return Table(T("orders").df.select("o_orderkey", F.when(c("o_custkey") % 3 != 0, c("o_custkey")).alias("o_custkey")))  # without a key: unmatched


_C = "(SELECT c_custkey, c_mktsegment FROM customer)"
_O = "(SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders)"
for _how, _sql in _JOINS.items():
    table(f"join_{_how}", f"SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey FROM {_C} a {_sql} {_O} b ON a.c_custkey = b.o_custkey")(lambda T, how=_how: _customers(T).join(_orders(T), left_on="c_custkey", right_on="o_custkey", how=how))
table("join_semi", f"SELECT * FROM {_C} a WHERE c_custkey IN (SELECT o_custkey FROM {_O})")(lambda T: _customers(T).join(_orders(T), left_on="c_custkey", right_on="o_custkey", how="semi"))
table("join_anti", f"SELECT * FROM {_C} a WHERE NOT EXISTS (SELECT 1 FROM {_O} b WHERE b.o_custkey = a.c_custkey)")(lambda T: _customers(T).join(_orders(T), left_on="c_custkey", right_on="o_custkey", how="anti"))
table("join_cross", "SELECT r_name, n_name FROM region, nation")(lambda T: T("region").select("r_name").join(T("nation").select("n_name"), how="cross"))


@table("join_after_udf", f"SELECT o_orderkey, o_custkey, o_totalprice * 2.0 + 3.0 AS y, c_mktsegment FROM orders JOIN {_C} a ON o_custkey = c_custkey")
def _(T):
    return T("orders").select("o_orderkey", "o_custkey", y=s.affine(c("o_totalprice"))).join(_customers(T), left_on="o_custkey", right_on="c_custkey").exclude("c_custkey")


_K1, _K2 = "SELECT o_custkey AS k FROM orders", "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS k FROM customer"


def _keys(T):
    return Table(T("orders").df.select(c("o_custkey").alias("k"))), Table(T("customer").df.select(F.when(c("c_custkey") % 3 == 0, c("c_custkey")).alias("k")))


for _name, _op in {"concat": "UNION ALL", "union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    table(_name, f"{_K1} {_op} {_K2}")(lambda T, name=_name: getattr(_keys(T)[0], name)(_keys(T)[1]))


@table("union_by_name", "SELECT r_regionkey AS k, r_name AS name, NULL::INTEGER AS extra FROM region UNION SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(T):
    a = T("region").select(name=c("r_name"), k=c("r_regionkey"))
    return a.union_by_name(T("nation").select(k=c("n_nationkey"), extra=c("n_regionkey"), name=c("n_name")))


@table("union_all_by_name", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(T):
    return T("region").select(name=c("r_name"), k=c("r_regionkey")).union_all_by_name(T("nation").select(k=c("n_nationkey"), name=c("n_name")))


@table("pipe_transform", "SELECT r_regionkey + 1 AS k FROM region")
def _(T):
    return T("region").pipe(lambda x, n: x.select(k=c("r_regionkey") + n), 1)



# more of the expression language

_doc("op_index", "x", lambda: s.first_character(c("text")), "substr(text, 1, 1)")
_doc("op_index_negative", "x", lambda: s.last_character(c("text")), "right(text, 1)")
_doc("fn_strip", "x", lambda: s.stripped(F.concat(F.lit(" \t "), "lang", F.lit("\n "))), "lang")
_doc("fn_contains", "x", lambda: s.mentions(c("text")), "contains(text, 'license')")
_doc("fn_replace", "x", lambda: s.swapped(c("text")), "replace(text, 'e', 'é')")
_line("op_mod", "y", lambda: s.remainder(c("l_orderkey")), "((-l_orderkey % 7) + 7) % 7")
_line("op_negate", "y", lambda: s.negated(c("l_tax")), "-l_tax")
_line("fn_min_max", "y", lambda: s.clamped(c("l_quantity")), "least(greatest(l_quantity, 10.0), 40.0)")
_line("op_not", "y", lambda: s.not_small(c("l_quantity")), "NOT l_quantity < 10")
_line("op_field_and_argument", "y", lambda: s.discounted_row(F.struct(c("l_extendedprice").alias("price")), c("l_discount")), "l_extendedprice * (1.0::DOUBLE - l_discount)")
_line("op_map_lookup", "y", lambda: s.looked_up(F.create_map(F.lit("A"), c("l_partkey"), F.lit("N"), c("l_suppkey"), F.lit("R"), c("l_orderkey")), c("l_returnflag")), "CASE l_returnflag WHEN 'A' THEN l_partkey WHEN 'N' THEN l_suppkey ELSE l_orderkey END")


@query("vector_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS y FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
def _(d):
    """Cosine with one vector: dot products by zip_with and aggregate, inside code generation."""
    first = F.broadcast(d.embeddings.where("vec_id = 0").select(c("embedding").alias("other")))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)

    y = dot("embedding", "other") / F.sqrt(dot("embedding", "embedding") * dot("other", "other"))
    return d.embeddings.crossJoin(first).select("vec_id", F.round(y, 6).alias("y"))


@query("union_of_lowered", "SELECT l_orderkey AS k, l_quantity * 2.0 + 3.0 AS y FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice + 10.0 FROM orders")
def _(d):
    return Table(select(d.lineitem, k=c("l_orderkey"), y=s.affine(c("l_quantity")))).union_all(Table(select(d.orders, k=c("o_orderkey"), y=s.plus_ten(c("o_totalprice"))))).df


# other names of an operation

_LARGE = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000"
table("filter_alias", _LARGE)(lambda T: T("orders").filter(c("o_totalprice") >= 100000).select("o_orderkey", "o_totalprice"))
for _name in ("unique", "drop_duplicates"):
    table(_name, "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda T, name=_name: getattr(T("lineitem").select("l_returnflag", "l_linestatus"), name)())
table("melt", "SELECT c_custkey, 'c_nationkey' AS variable, c_nationkey::DOUBLE AS value FROM customer UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer")(
    lambda T: T("customer").with_column("c_nationkey", c("c_nationkey").cast("double")).melt(["c_custkey"], ["c_nationkey", "c_acctbal"])
)
table("transform_alias", "SELECT r_regionkey * 2 AS k FROM region")(lambda T: T("region").transform(lambda x: x.select(k=c("r_regionkey") * 2)))


@table("sort_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def _(T):
    """A top-k report, in which the order shows."""
    return T("orders").sort("o_totalprice", "o_orderkey", desc=[True, False]).limit(50).select("o_orderkey", "o_totalprice")


@table("sample_bounds", "SELECT true AS near_half, 0::BIGINT AS strangers, 0::BIGINT AS repeated")
def _(T):
    """A sample without replacement: about half of the rows, none twice, none that the table lacks."""
    all_rows = T("orders").select("o_orderkey", drawn=F.lit(0))
    drawn = T("orders").sample(0.5, seed=7).select("o_orderkey", drawn=F.lit(1))
    of_key = all_rows.union_all(drawn).groupby("o_orderkey").agg(F.sum("drawn").alias("drawn"), F.count(F.when(c("drawn") == 0, 1)).alias("there"))
    share = F.sum("drawn") / F.sum("there")
    return of_key.agg(((share > 0.4) & (share < 0.6)).alias("near_half"), F.count_if(c("there") == 0).alias("strangers"), F.count_if(c("drawn") > 1).alias("repeated"))


# sources, sinks and results: what is written or handed over, read again

_CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("write_parquet_read", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(d):
    """Partitioned by a column: the filter on it chooses folders."""
    path = io.fresh_folder(d.spark, "orders")
    Table(d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")).write_parquet(path, partition_by=["o_orderstatus"])
    return read_parquet(d.spark, path).where(c("o_orderstatus") == "F")


for _name in ("csv", "json", "orc"):

    @query(f"write_{_name}_read", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    def _(d, name=_name):
        path = io.fresh_folder(d.spark, "customer")
        getattr(Table(d.customer), f"write_{name}")(path)
        return io.read_jsonl(d.spark, path, _CUSTOMER) if name == "json" else d.spark.read.schema(_CUSTOMER).format(name).load(path)


@query("read_lines", "SELECT count(*)::BIGINT AS n, sum(length(c_name))::BIGINT AS letters FROM customer")
def _(d):
    path = io.fresh_folder(d.spark, "lines")
    io.write(d.customer.select("c_name"), path, "text")
    return io.read_lines(d.spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters"))


@query("parquet_glob", "SELECT s_suppkey, s_name FROM supplier")
def _(d):
    return read_parquet(d.spark, f"{d.folder}/suppl*.parquet").select("s_suppkey", "s_name")


@query("in_memory_columns", "SELECT k::INTEGER AS k, x * 2.0 + 3.0 AS y FROM (VALUES (0, 0.0::DOUBLE), (1, 1.25), (2, -2.5), (3, 1e300), (4, 5e-324)) v(k, x)")
def _(d):
    return select(io.from_pydict(d.spark, {"k": [0, 1, 2, 3, 4], "x": [0.0, 1.25, -2.5, 1e300, 5e-324]}, "k int, x double"), "k", y=s.affine(c("x")))


_NATION = "n_nationkey int, n_name string, n_regionkey int"
_HANDED = {
    "to_pydict": lambda x: x.to_pydict(),
    "to_pylist": lambda x: _by_column(x.to_pylist()),
    "to_arrow": lambda x: x.to_arrow().to_pydict(),
    "to_pandas": lambda x: x.to_pandas().to_dict("list"),
    "collect": lambda x: _by_column([r.asDict() for r in x.collect()]),
    "iter_rows": lambda x: _by_column(list(x.iter_rows())),
    "to_arrow_iter": lambda x: _by_column([r for b in x.to_arrow_iter() for r in b.to_pylist()]),
    "iter_partitions": lambda x: _by_column([r for t in x.iter_partitions() for r in t.to_pylist()]),
}


def _by_column(rows: list[dict]) -> dict[str, list]:
    return {k: [r[k] for r in rows] for k in rows[0]}


for _name, _handed in _HANDED.items():

    @query(_name, "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    def _(d, handed=_handed):
        """Results go to the caller, who holds them; nation has 25 rows at any scale."""
        columns = handed(Table(d.nation.select("n_nationkey", "n_name", "n_regionkey")))
        return io.from_pydict(d.spark, columns, _NATION)


@query("count_rows", "SELECT count(*)::BIGINT AS n FROM lineitem")
def _(d):
    return io.from_pydict(d.spark, {"n": [len(Table(d.lineitem))]}, "n long")
