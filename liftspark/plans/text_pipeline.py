"""The thirteen stages of the text pipeline, each a function from frame to frame.

Mappers keep the name of the column, so that neighbouring projections
collapse into one. Models that aren't part of this engine are replaced by
deterministic stand-ins: ``language_score`` counts function words of six
languages, ``repetition`` is the share of distinct words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..ops import where, with_columns

LINKS = r'https?://[^ \t\r\n<>"]+'
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
COPYRIGHT = r"(?i)(copyright|\(c\)) [^\n]*"

#: Function words of six languages: fixed values.
FUNCTION_WORDS = {
    "en": " (the|of|and|to|in|that|is|for) ",
    "fr": " (le|la|les|de|des|et|que|une) ",
    "de": " (der|die|das|und|von|ist|nicht|ein) ",
    "es": " (el|los|las|que|una|por|con|del) ",
    "it": " (il|che|di|per|una|sono|nel|gli) ",
    "pt": " (os|uma|para|com|dos|mais|foi|ao) ",
}


def clean_html(df: DataFrame, column: str = "text") -> DataFrame:
    return with_columns(df, {column: t.strip_tags(F.col(column))})


def clean_links(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, LINKS, ""))


def clean_email(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, EMAIL, ""))


def clean_copyright(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, COPYRIGHT, ""))


def fix_unicode(df: DataFrame, column: str = "text") -> DataFrame:
    """NFC. ASCII texts have that form already, so only the others visit Python."""
    other = F.octet_length(column) > F.length(column)
    fixed = with_columns(df, {"__nfc": t.fix_unicode(F.when(other, F.col(column)).otherwise(F.lit("")))})
    return fixed.withColumn(column, F.when(other, F.col("__nfc")).otherwise(F.col(column))).drop("__nfc")


def normalize_punctuation(df: DataFrame, column: str = "text") -> DataFrame:
    return with_columns(df, {column: t.normalize_punctuation(F.col(column))})


def normalize_space(df: DataFrame, column: str = "text") -> DataFrame:
    return with_columns(df, {column: t.normalize_space(F.col(column))})


def settled(df: DataFrame) -> DataFrame:
    """Keeps later filters above the projections made so far.

    Without it each filter is pushed below them and works out the cleaned text
    anew. A column that isn't deterministic stops that, as long as it is asked
    for, which ``released`` does."""
    return df.withColumn("__row", F.monotonically_increasing_id())


def released(df: DataFrame) -> DataFrame:
    return df.where("__row >= 0").drop("__row")


def length_filter(df: DataFrame, column: str = "text", low: int = 200, high: int = 20000) -> DataFrame:
    return where(df, t.length_between(F.col(column), low=low, high=high))


def alnum_filter(df: DataFrame, column: str = "text", ratio: float = 0.2) -> DataFrame:
    return where(df, t.alnum_at_least_or_empty(F.col(column), ratio=ratio))


def language_score(text: Column) -> Column:
    """The largest count of function words of one language."""
    return F.greatest(*[F.regexp_count(text, F.lit(p)) for p in FUNCTION_WORDS.values()])


def language_filter(df: DataFrame, column: str = "text", least: int = 1) -> DataFrame:
    return df.where(language_score(F.lower(column)) >= least)


def repetition(text: Column) -> Column:
    words = F.split(text, " ")
    return F.size(F.array_distinct(words)) / F.size(words)


def perplexity_filter(df: DataFrame, column: str = "text", least: float = 0.1) -> DataFrame:
    return df.where(repetition(F.col(column)) >= least)


def dedup(df: DataFrame, column: str = "text") -> DataFrame:
    """One row for each text, that of the smallest doc_id. Texts are compared by digest, so none is shuffled twice over."""
    others = [c for c in df.columns if c != "doc_id"]
    first = F.min(F.struct("doc_id", *others)).alias("r")
    return df.groupBy(F.sha2(column, 256).alias("__key")).agg(first).select("r.*").select(*df.columns)


def chunk(df: DataFrame, column: str = "text", sentences: str = r"[.] ") -> DataFrame:
    """A row for each sentence, with its place."""
    return df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, sentences)).alias("chunk_no", "chunk"))


def text_pipeline(df: DataFrame) -> DataFrame:
    for stage in (clean_html, clean_links, clean_email, clean_copyright, fix_unicode, normalize_punctuation, normalize_space, settled, length_filter, alnum_filter, language_filter, perplexity_filter, released, dedup, chunk):
        df = stage(df)
    return df
