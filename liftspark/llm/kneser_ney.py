"""LM scoring (4): an interpolated modified Kneser-Ney bigram model.

Counting. Tasks count pairs (context, word) of the training texts, a text
being framed by a begin and an end, and send packed blocks to shards chosen
by the context's hash. Contexts that would overfill a shard are split by
word; which ones is planned on one text in ``PLANNED``, and steers only where
pairs are counted. A shard adds up its pairs and writes one file: hashes of
the pairs in order, with counts. It sends on what it knows of each context
(total, and followers seen once, twice, more often) and of each word (number
of contexts), which shards by hash add up and write as one file each, again
sorted. All counts cover all training texts; none is pruned.

Scoring. Workers memory-map the files and look up the distinct words and
pairs of a block of texts by binary search, shard by shard, so memory doesn't
depend on the model's size. Where the shared folder isn't mounted, a worker
copies a file beside itself when it first needs it. A file that was written
and can't be found is an error, never a count of nothing.

Model. p(w|c) = max(n(c,w) - D(n), 0) / n(c) + g(c) p(w), with three
discounts from the counts of counts and g(c) what they leave; p(w) likewise
from the numbers of contexts, interpolated with 1 / (V + 1), so that any
unknown word has mass. Logarithms are to base 10.

Defined cases: a null or empty text has one token, its end; with no training
texts N and V are 0 and every probability is 1 (score 0); a null doc_id is
neither held out nor learned from; repeated rows are learned from and scored
each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .storage import fresh, local_file, put_file
from .textvec import BLANK, Words, mix

PLANNED = 32
FLUSH = 3_000_000  # pairs a task holds before it counts them
BEGIN, END = (int(x) for x in mix(np.array([0xBE61, 0xE0D], dtype=np.uint64)))

_U = np.uint64
_CTX = np.dtype([("h", "<u8"), ("c", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


def _framed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a block with each text's end, their contexts, and where texts begin."""
    n = len(words.first) - 1
    tokens = np.insert(words.hash, words.first[1:], _U(END))
    first = words.first + np.arange(n + 1)
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[first[:-1]] = _U(BEGIN)
    return tokens, contexts, first


def pair_key(contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(contexts * _U(0x9E3779B97F4A7C15) + tokens)


def shard_of(contexts: np.ndarray, tokens: np.ndarray, shards: int, hot: np.ndarray, parts: np.ndarray) -> np.ndarray:
    h = mix(contexts ^ _U(0x5AD))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
        split = np.flatnonzero(hot[at] == contexts)
        part = (tokens[split] >> _U(7)) % parts[at[split]].astype(np.uint64)
        h[split] = mix(h[split] + part)
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _range_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def _totals(contexts: np.ndarray, tokens: np.ndarray, counts: np.ndarray, lead: np.ndarray | None = None) -> tuple:
    """Adds up counts of equal pairs; the result is sorted by (lead, context, word)."""
    order = np.lexsort((tokens, contexts) if lead is None else (tokens, contexts, lead))
    c, t, n = contexts[order], tokens[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1]))))
    return c[at], t[at], np.add.reduceat(n, at), order[at]


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype="<u8")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data, dtypes: tuple[str, ...]) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    head = np.frombuffer(data, "<u8", 2 * n, 8)
    out, at = [], 8 + 16 * n
    for i, d in enumerate(dtypes):
        out.append(np.frombuffer(data, d, int(head[2 * i]), at))
        at += int(head[2 * i] * head[2 * i + 1])
    return out


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that make up at least a thousandth of what a task saw, with their counts, and all that it saw as number 0."""
    for b in batches:
        seen = [_framed(Words(buf, offsets, BLANK))[1] for _, _, buf, offsets in textvec.blocks(b["text"])]
        if seen:
            u, n = np.unique(np.concatenate(seen), return_counts=True)
            big = n >= max(2, n.sum() / 1000)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(u[big], _U(0)).view(np.int64)), pa.array(np.append(n[big], n.sum()))], names=["h", "n"])


def _count(shards: int, hot: np.ndarray, parts: np.ndarray):
    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        c, t = (np.concatenate(x) for x in zip(*held, strict=True))
        s = shard_of(c, t, shards, hot, parts)
        c, t, n, at = _totals(c, t, np.ones(len(c), dtype=np.uint32), s)
        s = s[at]
        cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(s)), strict=True):
            own = c[a:b]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows.append(_pack(own[first], np.diff(np.append(first, b - a)).astype("<u4"), t[a:b], n[a:b].astype("<u4")))
        return pa.RecordBatch.from_arrays([pa.array(s[cuts], pa.int32()), pa.array(rows, pa.binary())], names=["shard", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for _, _, buf, offsets in textvec.blocks(b["text"]):
                t, c, _ = _framed(Words(buf, offsets, BLANK))
                held.append((c, t))
                size += len(t)
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _pairs(uri: str, shards: int):
    """Writes the file of each shard; sends on contexts, words and counts of counts by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[bytes]] = {}
        for b in batches:
            for shard, block in zip(b["shard"].to_pylist(), b["block"].to_pylist(), strict=True):
                by_shard.setdefault(shard, []).append(block)
        for shard in sorted(by_shard):
            parts = [_unpack(x, ("<u8", "<u4", "<u8", "<u4")) for x in by_shard.pop(shard)]
            c = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            t, n = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]).astype(np.uint64)
            del parts
            c, t, n, _ = _totals(c, t, n)
            key = pair_key(c, t)
            order = np.argsort(key)
            small = np.minimum(n[order], 255).astype(np.uint8)
            large = np.flatnonzero(small == 255)
            put_file(f"{uri}/pairs-{shard}", _pack(key[order], small, large.astype("<u8"), n[order][large]))
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            ctx = np.empty(len(first), dtype=_CTX)
            ctx["h"], ctx["c"] = c[first], np.add.reduceat(n, first)
            for name, is_it in (("n1", n == 1), ("n2", n == 2), ("n3", n >= 3)):
                ctx[name] = np.add.reduceat(is_it.astype(np.uint32), first)
            words, k = np.unique(t, return_counts=True)
            cr, wr = _range_of(ctx["h"], shards), _range_of(words, shards)
            rows = []
            for r in range(shards):
                x, y = slice(*np.searchsorted(cr, [r, r + 1])), slice(*np.searchsorted(wr, [r, r + 1]))
                own = ctx[x]
                rows.append(_pack(*(np.ascontiguousarray(own[f]) for f in _CTX.names), words[y], k[y].astype("<u4")))
            counts = [int((n == i).sum()) for i in range(1, 5)] + [len(n), shard]
            yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(rows, pa.binary()), pa.array([counts] + [[]] * (shards - 1), pa.list_(pa.int64()))], names=["range", "block", "counts"])

    return run


def _words(uri: str):
    """Writes the file of each hash range; returns counts of counts of pairs (as range -1) and words, and the shards written (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[bytes]] = {}
        pairs, written = np.zeros(5, dtype=np.int64), []
        for b in batches:
            for r, block, counts in zip(b["range"].to_pylist(), b["block"].to_pylist(), b["counts"].to_pylist(), strict=True):
                by_range.setdefault(r, []).append(block)
                if counts:
                    pairs += counts[:5]
                    written.append(counts[5])
        rows = [[-1, 0, 0, 0, *pairs.tolist()]] + [[-2, shard, 0, 0, 0, 0, 0, 0, 0] for shard in written]
        for r in sorted(by_range):
            parts = [_unpack(x, ("<u8", "<u8", "<u4", "<u4", "<u4", "<u8", "<u4")) for x in by_range.pop(r)]
            h = np.concatenate([p[0] for p in parts] + [p[5] for p in parts])
            if not len(h):
                continue
            cols = [np.concatenate([p[i] for p in parts] + [np.zeros(sum(len(p[5]) for p in parts), dtype=np.uint64)]).astype(np.uint64) for i in range(1, 5)]
            cols.append(np.concatenate([np.zeros(sum(len(p[0]) for p in parts), dtype=np.uint64)] + [p[6] for p in parts]).astype(np.uint64))
            del parts
            order = np.argsort(h, kind="stable")
            h = h[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            h, (c, n1, n2, n3, k) = h[at], [np.add.reduceat(x[order], at) for x in cols]
            put_file(f"{uri}/words-{r}", _pack(h, c, n1.astype("<u4"), n2.astype("<u4"), n3.astype("<u4"), k.astype("<u4")))
            begin = int(c[h == _U(BEGIN)].sum())
            known = (c > 0) & (h != _U(BEGIN))
            rows.append([r, int(c[known].sum()), int(known.sum()), begin, *(int((k == i).sum()) for i in range(1, 5)), int((k > 0).sum())])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["range", "tokens", "words", "texts", "n1", "n2", "n3", "n4", "all"])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D(0..3) of modified Kneser-Ney from counts of counts 1 to 4."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for i in (1, 2, 3):
            if n[i - 1]:
                out[i] = min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i)
    return out


@dataclass(frozen=True)
class Model:
    """What every worker needs beside the files."""

    uri: str
    shards: int
    hot: tuple[int, ...]
    parts: tuple[int, ...]
    tokens: int  # N
    words: int  # V
    texts: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    pairs: int  # distinct pairs
    word_rest: float  # mass that the words' discounts leave
    ranges: frozenset[int] = field(default_factory=frozenset)  # that have a file of words
    written: frozenset[int] = field(default_factory=frozenset)  # shards that have a file of pairs


class Lookup:
    """Memory-mapped files of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, list[np.ndarray]] = {}
        self.hot, self.parts = np.array(model.hot, dtype=np.uint64), np.array(model.parts, dtype=np.int64)

    def _file(self, name: str, dtypes: tuple[str, ...]) -> list[np.ndarray]:
        if name not in self.files:
            self.files[name] = _unpack(np.memmap(local_file(f"{self.model.uri}/{name}"), dtype=np.uint8, mode="r"), dtypes)
        return self.files[name]

    def words(self, h: np.ndarray) -> np.ndarray:
        """Rows c, n1, n2, n3, k for sorted distinct hashes."""
        out = np.zeros((5, len(h)), dtype=np.float64)
        r = _range_of(h, self.model.shards)
        for own in np.unique(r):
            if own not in self.model.ranges:
                continue
            x = slice(*np.searchsorted(r, [own, own + 1]))
            keys, *cols = self._file(f"words-{own}", ("<u8", "<u8", "<u4", "<u4", "<u4", "<u4"))
            at = np.minimum(np.searchsorted(keys, h[x]), len(keys) - 1)
            hit = keys[at] == h[x]
            for i, col in enumerate(cols):
                out[i, x] = np.where(hit, col[at], 0)
        return out

    def pairs(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        out = np.zeros(len(contexts), dtype=np.float64)
        if not self.model.pairs:
            return out
        key = pair_key(contexts, tokens)
        shard = shard_of(contexts, tokens, self.model.shards, self.hot, self.parts)
        order = np.lexsort((key, shard))
        s = shard[order]
        cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else []
        for a, b in zip(cuts, [*cuts[1:], len(s)], strict=True):
            own = order[a:b]
            if int(s[a]) not in self.model.written:  # no pair fell to this shard
                continue
            keys, small, large, many = self._file(f"pairs-{s[a]}", ("<u8", "u1", "<u8", "<u8"))
            at = np.minimum(np.searchsorted(keys, key[own]), len(keys) - 1)
            n = np.where(keys[at] == key[own], small[at], 0).astype(np.float64)
            full = np.flatnonzero(n == 255)
            n[full] = many[np.searchsorted(large, at[full].astype(np.uint64))]
            out[own] = n
        return out

    def score(self, tokens: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: whether it is known, its base score and its score."""
        m = self.model
        u, at = np.unique(np.concatenate([tokens, contexts]), return_inverse=True)
        c, n1, n2, n3, k = self.words(u)
        d, e = np.array(m.pair_discounts), np.array(m.word_discounts)
        # The end has as many tokens as there are texts, the begin none; as contexts it is the other way round.
        as_token = np.where(u == _U(END), m.texts, np.where(u == _U(BEGIN), 0, c))
        lower = np.maximum(k - e[np.minimum(k, 3).astype(np.int64)], 0) / m.pairs if m.pairs else np.zeros(len(u))
        lower = lower + m.word_rest / (m.words + 1)
        left = (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(c, 1)
        w, x = at[: len(tokens)], at[len(tokens) :]
        key, first, back = np.unique(pair_key(contexts, tokens), return_index=True, return_inverse=True)
        n = self.pairs(contexts[first], tokens[first])[back]
        upper = np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0) / np.maximum(c[x], 1)
        p = np.where(c[x] > 0, upper + left[x] * lower[w], lower[w])
        base = np.log10((as_token[w] + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        return as_token[w] > 0, base, np.log10(p)


@lru_cache(maxsize=2)
def _lookup(model: Model) -> Lookup:
    return Lookup(model)


def fit(docs: DataFrame, learnable: Column) -> Model:
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uri = fresh(spark, "bigram-model")
    train = docs.where(learnable).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plan = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(PLANNED)) == 0).select("text").mapInArrow(_plan, "h long, n long")
    seen = {r["h"]: r["n"] for r in plan.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(4 * shards + 1).collect()}
    total = seen.pop(0, 0)
    hot = sorted((h % 2**64, -(-4 * shards * n // total)) for h, n in seen.items() if 4 * shards * n > total)
    keys, parts = tuple(h for h, _ in hot), tuple(min(p, shards) for _, p in hot)
    blocks = train.select("text").mapInArrow(_count(shards, np.array(keys, dtype=np.uint64), np.array(parts, dtype=np.int64)), "shard int, block binary")
    sent = blocks.repartition(shards, "shard").mapInArrow(_pairs(uri, shards), "range int, block binary, counts array<long>")
    done = sent.repartition(shards, "range").mapInArrow(_words(uri), "range long, tokens long, words long, texts long, n1 long, n2 long, n3 long, n4 long, all long").collect()
    pairs = [sum(r[f] for r in done if r["range"] < 0) for f in ("n1", "n2", "n3", "n4", "all")]
    words = [sum(r[f] for r in done if r["range"] >= 0) for f in ("n1", "n2", "n3", "n4", "all")]
    texts, tokens, known = (sum(r[f] for r in done if r["range"] >= 0) for f in ("texts", "tokens", "words"))
    d, e = discounts(pairs), discounts(words)
    more = words[4] - words[0] - words[1]
    rest = (e[1] * words[0] + e[2] * words[1] + e[3] * more) / pairs[4] if pairs[4] else 1.0
    return Model(uri, shards, keys, parts, tokens + texts, known + bool(texts), texts, tuple(d.tolist()), tuple(e.tolist()), pairs[4], float(rest), frozenset(r["range"] for r in done if r["range"] >= 0), frozenset(r["tokens"] for r in done if r["range"] == -2))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; docs has doc_id, text, held_out."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _lookup(model)
        for b in batches:
            for i, j, buf, offsets in textvec.blocks(b["text"]):
                tokens, contexts, first = _framed(Words(buf, offsets, BLANK))
                known, base, p = found.score(tokens, contexts)
                n = np.diff(first)
                sums = [np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, p)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["held_out"].slice(i, j - i), pa.array(n), pa.array(sums[0]), pa.array(np.full(j - i, model.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=names)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_score(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold == 1, F.lit(False)).alias("held_out"))
    return score(base, fit(base, F.col("doc_id").isNotNull() & ~F.col("held_out")))
