"""Line dedup (3): a deletion-neighbourhood join.

Lines are what newlines separate, compared as sequences of words (runs
between blanks, A-Z lower-cased). Two lines are near if one word inserted,
deleted or substituted turns one into the other and the longer has at least
``LEAST`` words; shorter lines are near only if equal. Lines near each other,
directly or through others, form a class, of which the earliest line, by
doc_id and place, is kept.

1. Equal lines meet by a 128-bit digest; one line of each goes on.
2. If one edit parts two lines, they share their first or their last half.
   Lines that share neither with another line have no neighbour and go no
   further: the test loses nothing.
3. The others emit their deletion neighbourhood as hashed keys: the line
   itself, and the line without each of its words in turn, with the place of
   that word. Lines with the same variant and the same place differ by one
   substitution; lines that are the variant differ from the others by one
   insertion. So each (variant, place) links its lines to its first, and to
   the line that is the variant, and no group of lines is expanded to pairs.
4. The edit distance of linked lines is verified on their words, and links
   join into classes.

Every hash of a line, half or variant is a difference of prefix sums over the
block, so the neighbourhood of a line of n words costs n steps.

Defined cases: lines without words are no rows of the result, and neither are
null and empty texts; rows that share a doc_id share the decisions on equal
places; a null doc_id sorts first; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .storage import BROADCAST_ROWS, written
from .textvec import BLANK, Words, mix

LEAST = 8  # words of the longer line, for lines to be near without being equal

_U = np.uint64
_NULL = -(2**63)
_ID = "struct<doc: bigint, line: int>"


class Lines:
    """Lines with words of a block: ``first:end`` are a line's words, ``doc`` its text and ``number`` its place there."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        w = Words(buf, offsets, BLANK)
        self.hash = w.hash
        n = len(w)
        breaks = np.flatnonzero(buf == 10)
        doc = np.searchsorted(offsets, w.at, side="right") - 1
        line = np.searchsorted(breaks, w.at)
        new = np.ones(n, dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        self.first = np.flatnonzero(new)
        self.end = np.append(self.first[1:], n)
        self.doc = doc[self.first]
        self.number = line[self.first] - np.searchsorted(breaks, offsets)[self.doc]
        textvec._grown(n + 1)
        self.pow, self.inv = textvec._POW, textvec._INV
        self.sums = [np.concatenate(([_U(0)], np.cumsum(x * self.pow[:n], dtype=np.uint64))) for x in (self.hash, mix(self.hash ^ _U(0x11E5)))]

    def part(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Sum of words a:b as if they stood at the front."""
        s = self.sums[which]
        return (s[b] - s[a]) * self.inv[a]

    def whole(self, which: int) -> np.ndarray:
        return mix(self.part(self.first, self.end, which) + (self.end - self.first).astype(np.uint64))

    def halves(self) -> list[list[int]]:
        """Hashes of each line's leading and trailing halves; none for lines too short to have near ones."""
        n = self.end - self.first
        out = []
        for q in (n // 2, (n + 1) // 2):
            for side, (a, b) in enumerate(((self.first, self.first + q), (self.end - q, self.end))):
                out.append(mix(self.part(a, b) + (2 * q + side).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        keys = np.stack(out, axis=1).view(np.int64)
        odd, able = n % 2 == 1, n >= LEAST - 1
        return [row[: 4 if o else 2] if ok else [] for row, o, ok in zip(keys.tolist(), odd.tolist(), able.tolist(), strict=True)]

    def variants(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of line k without each word, in their order, and of the line as it is as the last."""
        a, b = int(self.first[k]), int(self.end[k])
        p = np.arange(a, b)
        s = self.sums[0]
        cut = (s[p] - s[a]) * self.inv[a] + (s[b] - s[p + 1]) * self.inv[a + 1]
        return np.append(mix(cut + _U(b - a - 1)), self.whole_of(a, b)), np.append(p - a, -1)

    def whole_of(self, a: int, b: int) -> np.uint64:
        return mix(((self.sums[0][b : b + 1] - self.sums[0][a : a + 1]) * self.inv[a]) + _U(b - a))[0]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, offsets in textvec.blocks(b["text"]):
            x = Lines(buf, offsets)
            yield pa.RecordBatch.from_arrays([
                b["doc"].slice(i, j - i).take(pa.array(x.doc)), pa.array(x.number, pa.int32()), pa.array((x.end - x.first).astype(np.int32)),
                pa.array(x.whole(0).view(np.int64)), pa.array(x.whole(1).view(np.int64)), pa.array(x.halves(), pa.list_(pa.int64())),
            ], names=["doc", "line", "n", "hi", "lo", "halves"])


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of the wanted lines, and the words of each."""
    for b in batches:
        wanted = b["wanted"].to_pylist()
        docs = b["doc"].to_pylist()
        for i, _, buf, offsets in textvec.blocks(b["text"]):
            x = Lines(buf, offsets)
            rows = []
            want = [set(w) for w in wanted[i : i + len(offsets) - 1]]
            for k, (d, n) in enumerate(zip(x.doc.tolist(), x.number.tolist(), strict=True)):
                if n in want[d]:
                    v, p = x.variants(k)
                    rows.append((docs[i + d], n, v.view(np.int64), p.astype(np.int32), x.hash[x.first[k] : x.end[k]].tobytes()))
            for a in range(0, len(rows), 1000):
                types = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows[a : a + 1000], strict=True), types, strict=True)], names=["doc", "line", "variants", "places", "words"])


def within_one_edit(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether at most one insertion, deletion or substitution turns x into y."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    if not len(differ):
        return True
    p = int(differ[0])
    if len(x) == len(y):
        return len(differ) == 1
    return bool((x[p + 1 :] == y[p:]).all()) if len(x) > len(y) else bool((x[p:] == y[p + 1 :]).all())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [within_one_edit(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b["x_words"], b["y_words"], strict=True)]
        yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n_words, class_doc_id, class_line_no, kept for every line with words."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc"), "text")
    lines = written(base.mapInArrow(_profile, "doc long, line int, n int, hi long, lo long, halves array<long>"), "line-profile")
    digest = ["n", "hi", "lo"]
    firsts = lines.groupBy(*digest).agg(F.min(F.struct("doc", "line")).alias("id"), F.first("halves").alias("halves"))
    firsts = written(firsts, "line-firsts")

    halves = firsts.select("id", F.explode("halves").alias("half"))
    shared = written(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half"), "line-halves")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    able = halves.join(shared, "half", "left_semi").select("id").distinct()
    wanted = written(able.groupBy("id.doc").agg(F.collect_list("id.line").alias("wanted")), "line-wanted")
    held = wanted.agg(F.sum(F.size("wanted") + 4)).first()[0] or 0  # numbers that a broadcast would hold
    few = F.broadcast(wanted) if held <= BROADCAST_ROWS else wanted
    around = base.join(few, "doc").select("doc", "text", "wanted").mapInArrow(_neighbourhoods, "doc long, line int, variants array<long>, places array<int>, words binary")
    around = written(around.withColumn("id", F.struct("doc", "line")).drop("doc", "line").dropDuplicates(["id"]), "line-variants")

    keys = around.select("id", F.explode(F.arrays_zip("variants", "places")).alias("v")).select("id", F.col("v.variants").alias("v"), F.col("v.places").alias("p"))
    groups = written(keys.groupBy("v", "p").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c")), "line-groups")
    same = keys.join(groups.where("c > 1").select("v", "p", "m"), ["v", "p"]).where("id != m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    cut = groups.where("p >= 0").select("v", F.col("m").alias("a")).join(groups.where("p < 0").select("v", F.col("m").alias("b")), "v").select("a", "b")
    pairs = same.unionByName(cut).where("a != b").distinct()
    words = around.select("id", "words")
    checked = pairs.join(words.select(F.col("id").alias("a"), F.col("words").alias("x_words")), "a").join(words.select(F.col("id").alias("b"), F.col("words").alias("y_words")), "b")
    long_enough = F.greatest(F.octet_length("x_words"), F.octet_length("y_words")) >= 8 * LEAST
    links = checked.where(long_enough).select("a", "b", "x_words", "y_words").mapInArrow(_verify, f"a {_ID}, b {_ID}")
    labels = components(links)

    classes = firsts.drop("halves").join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select(*digest, F.coalesce("label", "id").alias("class"))
    out = lines.drop("halves").join(classes, digest)

    def real(c):
        return F.when(c != _NULL, c)

    kept = (F.col("doc") == F.col("class.doc")) & (F.col("line") == F.col("class.line"))
    return out.select(real(F.col("doc")).alias("doc_id"), F.col("line").alias("line_no"), F.col("n").alias("n_words"), real(F.col("class.doc")).alias("class_doc_id"), F.col("class.line").alias("class_line_no"), kept.alias("kept"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with all columns, the text without the lines that are not kept. Rows without a doc_id stay as they are."""
    drop = line_classes(docs).where("NOT kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("line_no").alias("drop_lines"))
    drop = drop.select(F.col("doc_id").alias("drop_key"), "drop_lines")
    joined = docs.join(drop, docs["doc_id"] == drop["drop_key"], "left")
    left = F.filter(F.split(docs["text"], "\n"), lambda x, i: ~F.array_contains(drop["drop_lines"], i))
    text = F.when(drop["drop_lines"].isNull(), docs["text"]).otherwise(F.array_join(left, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
