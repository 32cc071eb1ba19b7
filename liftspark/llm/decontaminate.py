"""Benchmark decontamination (10): spaced-seed hashing.

A seed is a fixed mask over a window of words: the marked words are hashed,
the others ignored, so that a substituted word that falls on an unmarked
place leaves the hash as it is. Windows of all texts and of all benchmark
items under each mask meet in a join on the hash. A hit at word i of a text
and word j of an item puts the item on the diagonal i - j; the words of both
are then compared along it, and the text is contaminated by the item if
``WINDOW`` successive places (all of the item's where it has fewer) agree in
at least ``AGREE`` of them. Words are runs of letters, digits and characters
beyond ASCII, A-Z lower-cased.

The scan tests each hash against a bit table of fixed size, then against the
sorted seeds while these number at most ``BROADCAST_SEEDS`` (8 bytes each),
and hands on segments of the text around what may be a hit; joins decide.
Only those segments are shuffled, keyed by row, so a passage that a third of
all texts hold makes one small row each. Stretches of a row and an item on one
diagonal count as one, however far apart they are.

The masks of a window's length are such that one of them hits wherever the
tolerated substitutions fall (two in 13 words), so that every window that
would be accepted is compared. Only masks that the benchmark's items need are
run over the texts.

Items of fewer than ``SHORTEST`` words are found where all their words follow
each other; items without words are never found. Such an item says nothing of
a text if ordinary texts hold it too: ``contaminated`` tells all matches, but
``decontaminated`` drops no text for a short item that more texts hold than
``RARE`` of all, and more than ``RARE_TEXTS``.

Defined cases: null and empty texts are clean; a null item text has no words;
repeated rows and items count each, rows with a null doc_id are judged as all
others; of stretches that match equally many words the first counts; texts of
any length are read whole, block by block; empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .storage import small_batches, without, written
from .textvec import ALNUM, Words, mix
from .workers import task

WINDOW = 13
AGREE = 0.8
#: By words compared (an item's, at most WINDOW): masks of which one misses the substitutions, wherever as many fall as AGREE lets pass. Fixed values, found by search.
MASKS = {
    8: ("110111", "10111001"),
    9: ("1101111", "111100011"),
    10: ("110111", "110001101", "1011000011"),
    11: ("1101111", "111100011", "1100011011"),
    12: ("11011111", "111110011", "111101011", "11000110111"),
    13: ("111011111", "111111011", "1111101011", "11010011111", "111001100111"),
}
SHORTEST = 8  # words of an item that may have substitutions
RARE = 1e-4
RARE_TEXTS = 2
CONTEXT = 96  # words kept on either side of a hit
BITS = 22
BROADCAST_SEEDS = 1_000_000
BROADCAST_BYTES = 64_000_000  # of items' words

_KEYS = mix(np.arange(7001, 7065, dtype=np.uint64)) | np.uint64(1)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of all windows under a mask, by first word."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j, m in enumerate(mask):
        if m == "1":
            out += h[j : j + n] * (_KEYS[j % 64] + np.uint64(2 * (j // 64)))
    return mix(out + np.uint64(int(mask, 2) & 0xFFFFFFFF))


def _need(n: int, window: int, agree: float) -> int:
    """How many places of a window must agree for an item of n words."""
    size = min(window, n)
    return int(np.ceil(agree * size - 1e-9)) if n >= SHORTEST else size


def _masks_of(n: int, window: int = WINDOW, agree: float = AGREE) -> list[str]:
    """Masks for an item of n words that hit in every window which ``agreement`` accepts."""
    size = min(window, n)
    if not size:
        return []
    spared = size - _need(n, window, agree)
    if not spared:
        return ["1" * size]
    if size in MASKS and spared <= size - _need(size, size, AGREE):
        return list(MASKS[size])
    return ["1" * max(1, size // (spared + 1))]  # one piece of spared + 1 is whole


def _item_seeds(window: int, agree: float):
    """Words of each item and its seeds; items are numbered by their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = b["item_id"].to_pylist()
            for i, _, buf, offsets in textvec.blocks(b["text"]):
                w = Words(buf, offsets, ALNUM)
                rows = []
                for d, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    h = w.hash[x:y]
                    at, hs = [], []
                    for m in _masks_of(len(h), window, agree):
                        s = seeds(h, m)
                        at += range(len(s))
                        hs += s.view(np.int64).tolist()
                    rows.append((item, keys[i + d], len(h), h.tobytes(), at, hs))
                    item += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], names=["item", "item_id", "size", "item_words", "place", "hash"])

    return run


def _segments(shared, masks: list[str], context: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, known = shared.value
        segment = row = TaskContext.get().partitionId() << 40
        names = ["segment", "row", "doc_id", "mark", "begin", "n_words", "words", "at", "hash"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        for b in batches:
            row, done = row + b.num_rows, row
            keys, marks = b["doc_id"].to_pylist(), b["mark"].to_pylist()
            for i, _, buf, offsets in textvec.blocks(b["text"]):
                w = Words(buf, offsets, ALNUM)
                found, hashes = [], []
                for m in masks:
                    s = seeds(w.hash, m)
                    at = np.flatnonzero(table[(s >> np.uint64(64 - BITS)).astype(np.int64)])
                    if known is not None:
                        at = at[known[np.minimum(np.searchsorted(known, s[at]), len(known) - 1)] == s[at]] if len(known) else at[:0]
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    at = at[at + len(m) <= w.first[doc + 1]]
                    found.append(at)
                    hashes.append(s[at])
                if not any(map(len, found)):
                    continue
                at, hs = np.concatenate(found), np.concatenate(hashes)
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order]
                doc = np.searchsorted(w.first, at, side="right") - 1
                cut = np.flatnonzero((np.diff(at) > 2 * context) | (np.diff(doc) > 0)) + 1
                rows = []
                for x, y in zip(np.append(0, cut).tolist(), np.append(cut, len(at)).tolist(), strict=True):
                    d = int(doc[x])
                    lo, hi = max(int(w.first[d]), int(at[x]) - context), min(int(w.first[d + 1]), int(at[y - 1]) + context)
                    rows.append((segment, done + i + d, keys[i + d], marks[i + d], lo - int(w.first[d]), int(w.first[d + 1] - w.first[d]), w.hash[lo:hi].tobytes(), (at[x:y] - lo).tolist(), hs[x:y].view(np.int64).tolist()))
                    segment += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def agreement(text: np.ndarray, item: np.ndarray, diagonal: int, window: int, agree: float) -> tuple[int, int, int] | None:
    """(agreeing places, first, end in the text) of the stretch of qualifying windows on a diagonal, or None."""
    n = len(item)
    lo, hi = max(0, -diagonal), min(n, len(text) - diagonal)
    size = min(window, n)
    if hi - lo < size:
        return None
    same = text[lo + diagonal : hi + diagonal] == item[lo:hi]
    sums = np.concatenate(([0], np.cumsum(same)))
    good = np.flatnonzero(sums[size:] - sums[:-size] >= _need(n, window, agree))
    if not len(good):
        return None
    a, b = int(good[0]), int(good[-1]) + size
    hit = np.flatnonzero(same[a:b])
    return int(len(hit)), lo + diagonal + a + int(hit[0]), lo + diagonal + a + int(hit[-1]) + 1


def _verify(window: int, agree: float):
    names = ["row", "doc_id", "mark", "item", "item_id", "size", "line", "n_matched", "first_word", "end_word"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row, doc, mark, number, item_id, begin, size, words, item, diagonal in zip(*(b[c].to_pylist() for c in ("row", "doc_id", "mark", "item", "item_id", "begin", "size", "words", "item_words", "diagonal")), strict=True):
                got = agreement(np.frombuffer(words, np.uint64), np.frombuffer(item, np.uint64), diagonal, window, agree)
                if got:
                    rows.append((row, doc, mark, number, item_id, size, begin + diagonal, got[0], begin + got[1], begin + got[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)

    return run


def stretches(docs: DataFrame, benchmark: DataFrame, mark=None, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """row, doc_id, mark, item (both numbered), item_id, n_matched, first_word, end_word, share: what matches on each diagonal of a contaminated row."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(task(_item_seeds(window, agree)), "item long, item_id long, size int, item_words binary, place array<int>, hash array<long>")
    items = written(items, "benchmark-items")
    sizes = [r["n"] for r in items.select(F.least("size", F.lit(max(window, SHORTEST))).alias("n")).distinct().collect()]
    masks = sorted({m for n in sizes for m in _masks_of(n, window, agree)})
    places = items.select("item", F.explode(F.arrays_zip("place", "hash")).alias("s")).select("item", F.col("s.place").alias("place"), F.col("s.hash").alias("hash"))
    small = places.count() <= BROADCAST_SEEDS
    known = np.sort(places.select("hash").distinct().toPandas()["hash"].to_numpy().astype(np.int64).view(np.uint64)) if small else None
    shared = docs.sparkSession.sparkContext.broadcast((_bit_table(items), known))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (mark if mark is not None else F.lit(None).cast("binary")).alias("mark"))
    found = base.mapInArrow(task(_segments(shared, masks, CONTEXT)), "segment long, row long, doc_id long, mark binary, begin long, n_words long, words binary, at array<long>, hash array<long>")
    found = written(found, "decontamination-segments")
    if small:
        places = F.broadcast(places)
    hits = found.select("segment", F.explode(F.arrays_zip("at", "hash")).alias("s")).select("segment", F.col("s.at").alias("at"), F.col("s.hash").alias("hash"))
    pairs = hits.join(places, "hash").select("segment", "item", (F.col("at") - F.col("place")).cast("int").alias("diagonal")).distinct()
    words = items.select("item", "item_id", "size", "item_words")
    # A hot item needn't meet in one task where all items fit a broadcast; else AQE splits it.
    if small and (items.agg(F.sum(F.octet_length("item_words"))).first()[0] or 0) <= BROADCAST_BYTES:
        words = F.broadcast(words)
    full = pairs.join(found.drop("at", "hash"), "segment").join(words, "item")
    checked = full.select("row", "doc_id", "mark", "item", "item_id", "begin", "size", "words", "item_words", "diagonal").mapInArrow(task(_verify(window, agree)), "row long, doc_id long, mark binary, item long, item_id long, size long, line long, n_matched long, first_word long, end_word long")
    by_line = checked.groupBy("row", "doc_id", "mark", "item", "item_id", "size", "line").agg(F.sum("n_matched").alias("n_matched"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"))
    return by_line.withColumn("share", F.col("n_matched") / F.col("size")).drop("size", "line")


def matches(docs: DataFrame, benchmark: DataFrame, mark=None, window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """doc_id, mark, item_id, n_matched, first_word, end_word, share: the best stretch of each contaminated (row, item); items of one id are one."""
    best = F.max(F.struct("n_matched", (-F.col("first_word")).alias("before"), "end_word", "share")).alias("b")
    return stretches(docs, benchmark, mark, window, agree).groupBy("doc_id", "mark", "item_id").agg(best).select("doc_id", "mark", "item_id", "b.n_matched", (-F.col("b.before")).alias("first_word"), "b.end_word", "b.share")


def _bit_table(items: DataFrame) -> np.ndarray:
    """Which leading bits of a hash occur among the seeds: a table of 2**BITS entries, whatever the benchmark's size."""
    top = F.shiftrightunsigned(F.col("h"), 64 - BITS)
    table = np.zeros(1 << BITS, dtype=bool)
    bits = items.select(F.explode("hash").alias("h")).select(top.cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()
    table[bits.astype(np.int64)] = True
    return table


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_matched, first_word, end_word, share."""
    return matches(docs, benchmark).drop("mark")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of docs, with all their columns. A text is known by its whole SHA-256."""
    names, tag = docs.columns, "mark"
    while tag in names:
        tag += "_"
    key = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    found = written(stretches(docs, benchmark, mark=key).select("mark", "item", ((F.col("n_matched") < SHORTEST) & (F.col("share") == 1)).alias("short")).distinct(), "decontamination-found")
    common = found.where("short").groupBy("item").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > max(RARE_TEXTS, RARE * docs.count()))
    drop = written(found.join(common, "item", "left_anti").select(F.col("mark").alias(tag)).distinct(), "decontamination-drop")
    return without(docs.withColumn(tag, key), drop, tag).select(*[F.col(f"`{c}`") for c in names])
