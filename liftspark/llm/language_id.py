"""Language ID (9): nearest of several clustered centroids per language.

Features: byte n-grams of one to four bytes, letters lower-cased in A-Z and
every other ASCII byte taken as a blank, hashed into ``BUCKETS`` buckets;
weight (1 + log count) times the inverse document frequency, vectors of
length one. For each language up to ``CENTROIDS`` centroids are fitted by
spherical k-means; a text takes the language of the centroid with the largest
cosine, which is its score.

Document frequencies are counted over all labelled texts. Centroids are fitted
to a bounded sample, chosen by a hash of doc_id: at most ``SAMPLE`` labelled
texts in all, evenly over all languages, and at least one of each. The
executors turn the sample into vectors, so the driver holds at most SAMPLE
vectors of BUCKETS entries, or one for each language if these are more; the
model has no more centroids than that. Prediction reads every text whole.

Rejection: a text is rejected if its cosine is below half of what the most
distant half per cent of the sample has, a bound that falls with the square
root of the number of n-grams for texts of under ``FULL`` bytes, since short
texts are far from any centroid; or if it has no letter.

Defined cases: a null, empty or letterless text gives ``und`` with score 0,
and is rejected; with nothing to learn from all texts do; equal cosines go to
the language that sorts first; a null doc_id is neither learned from nor held
out; repeated rows give a row each; texts of any length are read whole, block
by block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .storage import small_batches
from .textvec import BLOCK
from .workers import task

BUCKETS = 8192
SAMPLE = 2000
CENTROIDS = 3
FULL = 400
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
for _a in range(26):
    _FOLD[97 + _a] = _FOLD[65 + _a] = 97 + _a
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_ORDERS = (1, 2, 3, 4)
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _bin(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row per text of a block."""
    n_docs = len(offsets) - 1
    folded = _FOLD[buf]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64) * BUCKETS, np.diff(offsets))
    out = np.zeros(n_docs * BUCKETS, dtype=np.int64)
    h = np.zeros(len(buf), dtype=np.uint32)
    for n in _ORDERS:
        if len(buf) < n:
            break
        h = h[: len(buf) - n + 1] * np.uint32(0x01000193) + folded[n - 1 :] * _MULTIPLIERS[n - 1] + np.uint32(n)
        same = doc[: len(h)] == doc[n - 1 :] if n > 1 else slice(None)
        g = h ^ (h >> np.uint32(15))
        out += np.bincount((doc[: len(h)] + (g * np.uint32(0x2C1B3C6D) >> np.uint32(19)))[same], minlength=len(out))
    return out.reshape(n_docs, BUCKETS)


def counts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, counts by text, bytes by text, whether it has a letter) for blocks of rows."""
    for i, j, buf, offsets in textvec.blocks(column):
        if j == i + 1 and len(buf) > BLOCK:
            x = np.zeros((1, BUCKETS), dtype=np.int64)
            for a in range(0, len(buf), BLOCK):
                part = buf[a : a + BLOCK + _ORDERS[-1] - 1]
                x += _bin(part, np.array([0, len(part)]))
            letter = np.array([bool(_ASCII_LETTER[buf].any())])
            spans = [(i, buf, offsets, x, letter)]
        else:
            spans = []
            for a in range(0, j - i, 128):
                o = offsets[a : a + 129]
                part = buf[o[0] : o[-1]]
                seen = np.concatenate(([0], np.cumsum(_ASCII_LETTER[part])))
                o = o - o[0]
                spans.append((i + a, part, o, _bin(part, o), seen[o[1:]] > seen[o[:-1]]))
        for row, part, o, x, letter in spans:
            for k in np.flatnonzero(~letter):
                letter[k] = any(map(str.isalpha, part[o[k] : o[k + 1]].tobytes().decode("utf-8")))
            yield row, x, np.diff(o), letter


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # BUCKETS x centroids
    owner: np.ndarray  # language of each centroid
    least: float  # cosine below which texts of FULL bytes or more are rejected

    def vectors(self, x: np.ndarray) -> np.ndarray:
        w = np.log1p(x, dtype=np.float32) * self.idf
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        return w / np.maximum(norm, 1e-9)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(x) @ self.centroids
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(x)), best].astype(np.float64), 0, 1)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    chosen = [0]
    while len(chosen) < min(k, len(v)):
        chosen.append(int((v @ v[chosen].T).max(axis=1).argmin()))
    c = v[chosen]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, x, size, letter in counts(b["text"]):
            at = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b["doc_id"].slice(row, len(x)), "lang": b["lang"].slice(row, len(x)), "size": pa.array(size), "letter": pa.array(letter),
                "places": pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), "n": pa.array([x[i][a].astype("<u4").tobytes() for i, a in enumerate(at)], pa.binary()),
            })


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts with a letter hold each bucket, then how many there are."""
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for b in batches:
        for _, x, _, letter in counts(b["text"]):
            out[:-1] += np.count_nonzero(x[letter], axis=0)
            out[-1] += np.count_nonzero(letter)
    yield pa.RecordBatch.from_pydict({"texts": pa.array([out], pa.list_(pa.int64()))})


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model | None:
    """Learns from the rows where ``learnable`` holds and text, lang and doc_id are not null: centroids from at most ``sample`` of them, or one for each language."""
    small_batches(docs.sparkSession)
    rows = docs.where(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    lettered = rows.where(F.col("text").rlike(r"\p{L}"))
    sizes = [(r["lang"], r["n"]) for r in lettered.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_003))
    # Spares most texts the sort; the least ``each`` chances of a language are below it.
    share = F.least(F.lit(1_000_003), (F.lit(1_000_003 * (2 * each + 40)) / F.col("n")).cast("long") + 1000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id"))
    names, numbers = zip(*sizes, strict=True)
    labels = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(names, pa.string()), "n": pa.array(numbers, pa.int64())})))
    picked = lettered.join(labels, "lang").withColumn("chance", chance).where(F.col("chance") < share).withColumn("rank", rank).where(F.col("rank") <= each)
    got = picked.select("doc_id", "text", "lang").mapInArrow(task(_sparse), "doc_id long, lang string, size long, letter boolean, places binary, n binary").where("letter").toPandas().sort_values(["lang", "doc_id", "size"])
    if not len(got):
        return None
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for i, (p, n) in enumerate(zip(got["places"], got["n"], strict=True)):
        x[i, np.frombuffer(p, "<u2")] = np.frombuffer(n, "<u4")
    texts = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in rows.select("text").mapInArrow(task(_frequencies), "texts array<long>").select(F.posexplode("texts").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        texts[r["bucket"]] = r["n"]
    idf = (np.log((1 + texts[-1]) / (1 + texts[:-1])) + 1).astype(np.float32)
    model = Model(sorted(set(got["lang"])), idf, np.empty(0), np.empty(0), 0.0)
    v = model.vectors(x)
    lang = got["lang"].to_numpy()
    fitted = [_kmeans(v[lang == name], CENTROIDS) for name in model.languages]
    model.centroids = np.ascontiguousarray(np.concatenate(fitted).T.astype(np.float32))
    model.owner = np.repeat(np.arange(len(fitted)), [len(c) for c in fitted])
    long = got["size"].to_numpy() >= FULL
    model.least = 0.5 * float(np.quantile(model.nearest(x)[1][long], 0.005)) if long.any() else 0.0
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs, then ``lang_pred``, ``score``, ``rejected`` (renamed with underscores where docs has such names)."""
    names = {}
    for c in ("lang_pred", "score", "rejected"):
        names[c] = c
        while names[c] in docs.columns:
            names[c] += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(names["lang_pred"], T.StringType()), T.StructField(names["score"], T.DoubleType()), T.StructField(names["rejected"], T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for row, x, size, letter in counts(b.column(place)):
                part = b.slice(row, len(x))
                if m is None:
                    lang, score, rejected = [UNDETERMINED] * len(x), np.zeros(len(x)), np.ones(len(x), dtype=bool)
                else:
                    best, score = m.nearest(x)
                    lang = [m.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                    score = np.where(letter, score, 0.0)
                    rejected = ~letter | (score < m.least * np.sqrt(np.minimum(1, size / FULL)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names, *names.values()])

    return docs.mapInArrow(task(run), schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    model = fit(docs, fold(F.col("doc_id"), 4) != 2)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(base, model).drop("text")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised, with all their columns."""
    model = fit(docs, fold(F.col("doc_id"), 4) != 2)
    judged = predict(docs, model)
    return judged.where(~F.col(judged.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
