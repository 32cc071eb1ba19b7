"""N-gram Jaccard join (1): multiple-global-order filtering.

A text's set holds its distinct five-word shingles, hashed. Two sets of
Jaccard similarity of at least 80 % share a token among the first
``n - ceil(0.8 n) + 1`` of each, under any order of all tokens. Several
global orders are used: all put frequent tokens last (by levels of frequency)
and differ in how they deal out tokens of a level. A candidate pair must
share prefix tokens under every order; only then are the sets compared.

1. One pass turns each text into (size, 128-bit digest of its set) and counts
   tokens that occur in several texts. Equal sets form a class, of which the
   smallest doc_id goes on.
2. Class representatives emit their prefix under the first order, packed into
   blocks by token range. Each range keeps tokens that several texts share.
   Tokens known to be frequent are split over salts.
3. Each token links its texts to one of them, a star. Pairs whose number of
   shared prefix tokens still allows similarity go on to the filters of the
   other orders: only prefixes are sent for these, and a pair must share enough
   of them under every order. What is left of the intersection is verified on
   whole sets. Both tests send a star's leader once for a block of its pairs,
   not with each. Links join into components.
4. Texts that share a token but lie in different components are then paired,
   all but those of the token's largest component against every other one,
   and go through the same filters and verification. Pairs inside one component
   needn't be tested, as they are connected already. In large stars all texts
   are measured against the leader, since what a text shares with the leader
   of a group of near copies excludes most others of the group: two of them
   share no more than either has in common with it, and what they share
   beside it. Where the first is too little, they are paired by those tokens
   alone which the leader lacks, and only if they share enough of these. So each
   linked pair ends in one component, while a group of near copies costs about
   a pair per member.

The frequency levels only steer the orders: results don't depend on them.
They cover all texts; their list has at most ``FREQUENT`` tokens of 12 bytes.
Tokens are 64-bit hashes; the filters send 32 bits of each, and count those
that coincide as shared, so that they lose no pair.

Defined cases: null and empty texts and texts without words have an empty set
and no links; rows that share a doc_id are one document, and their texts are
linked with each other (of such rows ``near_deduplicated`` keeps the one whose
JSON has the smallest SHA-256); a row with a null doc_id has no links and a
null component; texts of any length are read whole, block by block, a single
set being the most that is held of one; repeated rows give a row each; equal
sizes and frequencies are ordered by token and doc_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec
from .components import components
from .storage import first_of_each, only, scratch, small_batches, without, written
from .textvec import BLANK, Words, mix, shingle_sets
from .workers import task

WORDS = 5
NUMERATOR, DENOMINATOR = 80, 100
ORDERS = 3
FREQUENT = 500_000
LEAST_FREQUENCY = 8
SALT_EVERY = 4096  # texts of a frequent token per salt
MAX_SALTS = 256
LARGE_STAR = 32  # texts that may be linked with one leader
FLUSH = 1 << 20  # postings held by a task before they are packed
COUNTED = 1 << 21  # tokens counted at once
LEAST_PARTS = 64  # blocks that the pairs of one star are dealt to, at least
CLASSES = 1_000_000  # classes of equal sets that are broadcast, at most, being the largest

_POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4")])
_SEEDS = mix(np.arange(9001, 9001 + 16, dtype=np.uint64))


def needed(n: int) -> int:
    """Least overlap of a set of n tokens with any set similar to it."""
    return -(-NUMERATOR * n // DENOMINATOR)


def prefix_size(n: int) -> int:
    return n - needed(n) + 1 if n else 0


def similar(x: int, y: int, both: int) -> bool:
    return DENOMINATOR * both >= NUMERATOR * (x + y - both)


class Orders:
    """Global orders: levels of frequency first, then a permutation of its own for each order."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order]
        self.level = np.minimum(63, np.log2(np.maximum(self.counts, 1)).astype(np.uint64))

    def _find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tokens):
            return np.zeros(len(tokens), dtype=np.int64), np.zeros(len(tokens), dtype=bool)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return at, self.tokens[at] == tokens

    def keys(self, tokens: np.ndarray, j: int) -> np.ndarray:
        at, known = self._find(tokens)
        level = np.where(known, self.level[at], 0).astype(np.uint64) if len(self.tokens) else np.zeros(len(tokens), dtype=np.uint64)
        return level << np.uint64(58) | mix(tokens ^ _SEEDS[j]) >> np.uint64(6)

    def prefix(self, tokens: np.ndarray, j: int) -> np.ndarray:
        p = prefix_size(len(tokens))
        if p >= len(tokens):
            return tokens
        return tokens[np.argpartition(self.keys(tokens, j), p - 1)[:p]]

    def salts(self, tokens: np.ndarray) -> np.ndarray:
        at, known = self._find(tokens)
        if not len(self.tokens):
            return np.ones(len(tokens), dtype=np.int64)
        return np.where(known, np.clip(self.counts[at] // SALT_EVERY + 1, 1, MAX_SALTS), 1)


def _profile(k: int):
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        """Tokens that several of the texts hold, with how many do."""
        t = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        n = np.diff(np.append(at, len(t)))
        t, n = t[at][n > 1], n[n > 1]
        z = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(t), dtype=np.int8)), z, pa.array(n.astype(np.int64)), pa.array(t.view(np.int64)), z], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b in batches:
            ids = b["doc_id"]
            for i, j, buf, offsets in textvec.blocks(b["text"]):
                sets = shingle_sets(Words(buf, offsets, BLANK), k)
                hi = np.fromiter((mix(s).sum(dtype=np.uint64) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
                lo = np.fromiter((mix(s ^ _SEEDS[15]).sum(dtype=np.uint64) for s in sets), dtype=np.uint64, count=len(sets)).view(np.int64)
                for s, h in zip(sets, hi.tolist(), strict=True):
                    if h not in seen:
                        seen.add(h)
                        held.append(s)
                        size += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, dtype=np.int8)), ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo)], schema=schema)
                if size >= COUNTED:
                    yield repeated(held)
                    held, size, seen = [], 0, set()
        if held:
            yield repeated(held)

    return run


def _postings(shared, ranges: int, k: int):
    schema = pa.schema([("range", pa.int32()), ("salt", pa.int32()), ("block", pa.binary())])

    def packed(held: list[np.ndarray], orders: Orders) -> pa.RecordBatch:
        p = np.concatenate(held)
        span = (p["token"] >> np.uint64(32)).astype(np.int64) * ranges >> 32
        salts = orders.salts(p["token"])
        salt = np.where(salts > 1, (mix(p["doc"].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64) + 1, 0)
        key = span * (MAX_SALTS + 1) + salt
        order = np.argsort(key, kind="stable")
        key, p = key[order], p[order]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(at[1:], len(key))
        return pa.RecordBatch.from_arrays([pa.array(key[at] // (MAX_SALTS + 1), pa.int32()), pa.array(key[at] % (MAX_SALTS + 1), pa.int32()), pa.array([p[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(*shared.value)
        held, size = [], 0
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for i, _, buf, offsets in textvec.blocks(b["text"]):
                for d, s in enumerate(shingle_sets(Words(buf, offsets, BLANK), k)):
                    if not len(s):
                        continue
                    t = orders.prefix(s, 0)
                    p = np.empty(len(t), dtype=_POSTING)
                    p["token"], p["doc"], p["n"] = t, ids[i + d], len(s)
                    held.append(p)
                    size += len(t)
                if size >= FLUSH:
                    yield packed(held, orders)
                    held, size = [], 0
        if held:
            yield packed(held, orders)

    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of tokens with several texts; all of those of a salt, whose other texts may be elsewhere."""
    blocks, split = [], []
    for b in batches:
        for block, salt in zip(b["block"].to_pylist(), b["salt"].to_pylist(), strict=True):
            p = np.frombuffer(block, dtype=_POSTING)
            (split if salt else blocks).append(p)
    out = []
    if blocks:
        p = np.concatenate(blocks)
        del blocks
        token = p["token"]
        order = np.argsort(token, kind="stable")
        t = token[order]
        twin = t[1:] == t[:-1]
        keep = np.zeros(len(t), dtype=bool)
        keep[1:] |= twin
        keep[:-1] |= twin
        out.append(p[order[keep]])
    out += split
    for p in out:
        for a in range(0, len(p), 1 << 16):
            x = p[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x["token"].astype("<u8").view(np.int64)), pa.array(x["doc"].copy()), pa.array(x["n"].astype(np.int64))], names=["token", "doc", "n"])


def _sets(shared, k: int):
    """Sets of texts, and their prefixes under all orders but the first: (size, lengths, 32 bits of each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(*shared.value)

        def filters(s: np.ndarray) -> bytes:
            parts = [np.unique((orders.prefix(s, j) >> np.uint64(32)).astype("<u4")) for j in range(1, ORDERS)]
            return np.concatenate([np.array([len(s), *map(len, parts)], dtype="<u4"), *parts]).tobytes()

        for b in batches:
            ids = b["doc_id"]
            for i, j, buf, offsets in textvec.blocks(b["text"]):
                sets = shingle_sets(Words(buf, offsets, BLANK), k)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(map(filters, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "filters", "tokens"])

    return run


def _prefixes(data: np.ndarray) -> tuple[int, list[np.ndarray]]:
    ends = np.cumsum([ORDERS, *data[1:ORDERS]])
    return int(data[0]), [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def passes(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two texts share enough prefix tokens under each order to be similar.

    Of the tokens shared outside both prefixes, all lie behind the prefix that ends first."""
    (nx, px), (ny, py) = _prefixes(x), _prefixes(y)
    rest = max(needed(nx), needed(ny)) - 1
    least = -(-NUMERATOR * (nx + ny) // (NUMERATOR + DENOMINATOR)) - rest
    # Tokens of one text with the same 32 bits count once there.
    return all(len(np.intersect1d(a, b, assume_unique=True)) + prefix_size(nx) - len(a) >= max(1, least) for a, b in zip(px, py, strict=True))


def _filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block begin with its leader (a null y)."""
    leader = None
    for b in batches:
        keep = []
        for y, data in zip(b["y"].to_pylist(), b["data"], strict=True):
            data = np.frombuffer(data.as_buffer(), "<u4")
            if y is None:
                leader = data.copy()
            keep.append(y is not None and passes(leader, data))
        yield pa.RecordBatch.from_arrays([b["x"], b["y"]], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x = None
    for b in batches:
        pair, linked, overlap = [], [], []
        for member, y in zip(b["y"].to_pylist(), b["data"], strict=True):
            y = np.frombuffer(y.as_buffer(), np.uint64)
            pair.append(member is not None)
            if member is None:
                x = y.copy()
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(similar(len(x), len(y), both))
            overlap.append(both)
        ids = pa.RecordBatch.from_arrays([b["x"], b["y"]], names=["x", "y"]).filter(pa.array(pair, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(linked, pa.bool_()), pa.array(overlap, pa.int64())], names=["x", "y", "linked", "overlap"])


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of y that its block's leader lacks."""
    x = None
    for b in batches:
        for leader, member, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), b["data"], strict=True):
            y = np.frombuffer(y.as_buffer(), np.uint64)
            if member is None:
                x = y.copy()
            elif len(rest := np.setdiff1d(y, x, assume_unique=True)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), leader)), pa.array(np.full(len(rest), member)), pa.array(rest.view(np.int64))], names=["pivot", "doc", "token"])


def _blocks(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """Pairs x, y with data of y, in blocks of one x each, led by a row with the data of x (y is null there)."""
    parts = max(LEAST_PARTS, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.select("x", F.pmod(F.xxhash64("y"), F.lit(parts)).alias("part"), "y")
    data = sets.select("doc", F.col(column).alias("data"))
    members = pairs.join(data.withColumnRenamed("doc", "y"), "y").select("x", "part", "y", "data")
    leaders = pairs.select("x", "part").distinct().join(data.withColumnRenamed("doc", "x"), "x").select("x", "part", F.lit(None).cast("long").alias("y"), "data")
    rows = leaders.unionByName(members).repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    return rows.select("x", "y", "data")


def _tested(pairs: DataFrame, docs: DataFrame, shared, k: int) -> tuple[DataFrame, DataFrame]:
    """Pairs x, y (already written) that pass the filters of all orders, or are to be ``measured`` in any case, with whether
    they are linked and how many tokens they share; and the sets of their texts."""
    wanted = written(pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), "ngram-wanted")
    sets = written(only(docs, wanted, "doc_id").mapInArrow(task(_sets(shared, k)), "doc long, filters binary, tokens binary"), "ngram-sets")
    passed = _blocks(pairs.where("NOT measured"), sets, "filters").mapInArrow(task(_filter), "x long, y long")
    passed = written(passed.unionByName(pairs.where("measured").select("x", "y")), "ngram-passed")
    return written(_blocks(passed, sets, "tokens").mapInArrow(task(_verify), "x long, y long, linked boolean, overlap long"), "ngram-tested"), sets


def _sizes_fit(a: str, b: str) -> Column:
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def _enough_shared(c: Column) -> Column:
    """Whether c shared prefix tokens, of texts of nx and ny tokens, leave room for similarity: of the tokens shared beyond the shorter prefix,
    in the first order, all lie behind one text's own prefix."""
    rest = F.greatest(*[F.expr(f"({NUMERATOR} * {n} + {DENOMINATOR} - 1) div {DENOMINATOR} - 1") for n in ("nx", "ny")])
    both = NUMERATOR + DENOMINATOR
    return c + rest >= F.expr(f"({NUMERATOR} * (nx + ny) + {both} - 1) div {both}")


def _mixed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys with several labels, and each key's most frequent label as ``main``."""
    labels = rows.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("c"))
    labels = labels.groupBy(*key).agg(F.max(F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    return rows.join(labels.select(*key, F.col("main.label").alias("main")), key)


def _missing(n: str, o: str) -> Column:
    """How many tokens a text of n, of which its pivot has o, must share beside the pivot with any text like it."""
    return F.greatest(F.lit(1), F.expr(f"({NUMERATOR} * {n} + {DENOMINATOR} - 1) div {DENOMINATOR} - {o}"))


def _rare_first(others: DataFrame) -> DataFrame:
    """Of the tokens that a text has beside its pivot, the prefix by rarity in the pivot's group, without those that no other text has;
    ``shared`` tells how many of all these others have. Where the pivot lacks a token that most of its group have, few texts
    have so many more that they could be similar by it."""
    held = others.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("held"))
    own = Window.partitionBy("pivot", "doc")
    ranked = others.join(held, ["pivot", "token"]).withColumn("rank", F.row_number().over(own.orderBy("held", "token"))).withColumn("all", F.count(F.lit(1)).over(own)).withColumn("shared", F.sum((F.col("held") > 1).cast("long")).over(own))
    return ranked.where((F.col("rank") <= F.col("all") - _missing("n", "o") + 1) & (F.col("held") > 1)).drop("held", "rank", "all")


def _crossed(rows: DataFrame, key: list[str], where: Column) -> DataFrame:
    """Pairs x < y of texts that meet in a key, under different labels: how often (c), their sizes (nx, ny), and what they share with pivots (ox, oy).

    Each key gives a pair once: from its side outside the main label, or from the smaller doc_id if both are."""

    def side(df: DataFrame, z: str) -> DataFrame:
        own = [c for c in ("n", "label", "o", "pivot", "shared") if c in df.columns and c not in key]
        return df.select(*key, F.col("doc").alias(z), *[F.col(c).alias(f"{c}{z}") for c in own], (F.col("label") == F.col("main")).alias(f"central{z}"))

    few, every = side(rows.where("label != main"), "x"), side(rows, "y")
    once = (F.col("labelx") != F.col("labely")) & (F.col("centraly") | (F.col("x") < F.col("y")))
    pairs = few.join(every, key).where(once & _sizes_fit("nx", "ny") & where)
    first = F.col("x") < F.col("y")
    ends = [F.when(first, F.col(f"{c}x")).otherwise(F.col(f"{c}y")).alias(f"{c}x") for c in ("n", "o")] + [F.when(first, F.col(f"{c}y")).otherwise(F.col(f"{c}x")).alias(f"{c}y") for c in ("n", "o")]
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), *ends)
    return pairs.groupBy("x", "y", "nx", "ny", "ox", "oy").agg(F.count(F.lit(1)).alias("c"))


def _ends(base: DataFrame, rows: DataFrame, shared, k: int) -> DataFrame:
    """doc_id, component_id of documents that have a link or a copy; rows has their sizes and digests."""
    spark = base.sparkSession
    filled = rows.where("n > 0 AND doc_id IS NOT NULL")
    key = ["n", "hi", "lo"]
    classes = filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("members")).where("rep < last").drop("last")
    classes = written(classes, "ngram-classes")
    # No more than CLASSES can be so large; those are broadcast, so that the rows of one don't meet in a task.
    large = F.col("members") >= max(1000, rows.count() // CLASSES + 1)
    told = filled.join(F.broadcast(classes.where(large)), key).unionByName(filled.join(classes.where(~large), key))
    copies = written(told.where("doc_id != rep").select("doc_id", "rep").distinct(), "ngram-copies")
    # A doc_id whose rows have several texts stays in play if one of them has no class before it.
    idle = copies.select("doc_id").distinct()
    several = written(filled.select("doc_id", "n", "hi", "lo").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-several")
    idle = written(idle.join(several, "doc_id", "left_anti"), "ngram-idle")
    active = without(base.where(F.col("doc_id").isNotNull()), idle, "doc_id")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = active.mapInArrow(task(_postings(shared, ranges, k)), "range int, salt int, block binary")
    postings = written(blocks.repartition(ranges, "range", "salt").mapInArrow(task(_shared_tokens), "token long, doc long, n long"), "ngram-postings")

    # A token's leader is the text whose tokens the most texts share: of near copies the one they come from.
    shares = postings.groupBy("token").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    weights = postings.join(shares, "token").groupBy("doc").agg(F.sum("texts").alias("weight"))
    postings = written(postings.join(shares.select("token"), "token").join(weights, "doc"), "ngram-weighted")
    leaders = postings.groupBy("token").agg(F.max(F.struct("weight", (-F.col("doc")).alias("before"), "n")).alias("first")).select("token", (-F.col("first.before")).alias("leader"), F.col("first.n").alias("nx"))
    led = postings.join(leaders, "token")
    stars = led.where((F.col("doc") != F.col("leader")) & _sizes_fit("nx", "n")).groupBy(F.col("leader").alias("x"), F.col("doc").alias("y"), "nx", F.col("n").alias("ny")).agg(F.count(F.lit(1)).alias("c"))
    stars = written(stars, "ngram-stars")
    # A pair may share more tokens under other leaders; what is left out here comes up again below unless it is connected
    # by then. In large stars all are measured, as what a text shares with the leader spares it most of the others.
    near = stars.where(_enough_shared(F.col("c")))
    large = near.groupBy("x").count().where(F.col("count") >= LARGE_STAR).select("x")
    far = stars.where(~_enough_shared(F.col("c"))).join(large, "x", "left_semi")
    to_test = near.join(large.withColumn("measured", F.lit(True)), "x", "left").unionByName(far.withColumn("measured", F.lit(True)))
    star_pairs = written(to_test.select("x", "y", F.coalesce("measured", F.lit(False)).alias("measured")), "ngram-star-pairs")
    tested, sets = _tested(star_pairs, active, shared, k)
    links = tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = components(links)

    # A text's pivot is the leader it shares most with, of those it was tested against.
    best = tested.groupBy("y").agg(F.max(F.struct("overlap", (-F.col("x")).alias("before"))).alias("p"))
    pivots = written(best.select(F.col("y").alias("doc"), (-F.col("p.before")).alias("pivot"), F.col("p.overlap").alias("o")), "ngram-pivots")
    placed = postings.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    apart = written(_mixed(placed, ["token"]).join(pivots, "doc", "left").select("token", "doc", "n", "label", "main", "pivot", "o"), "ngram-apart")
    if not apart.isEmpty():
        # Two texts with one pivot share at most what each has in common with it, and what they share beside it. Where the
        # first is too little they meet in a token that the pivot lacks, so that a group of near copies isn't paired.
        least = F.expr(f"({NUMERATOR} * (nx + ny) + {NUMERATOR + DENOMINATOR - 1}) div {NUMERATOR + DENOMINATOR}")
        beside = least - F.least("ox", "oy")
        spared = F.coalesce((F.col("pivotx") == F.col("pivoty")) & (beside > 0), F.lit(False))
        crossed = _crossed(apart, ["token"], ~spared).where(_enough_shared(F.col("c")))
        grouped = pivots.join(postings.select("doc", "n").distinct(), "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        grouped = _mixed(grouped, ["pivot"])
        others = _blocks(grouped.select(F.col("pivot").alias("x"), F.col("doc").alias("y")), sets, "tokens").mapInArrow(task(_others), "pivot long, doc long, token long")
        others = written(others.join(grouped, ["pivot", "doc"]), "ngram-others")
        met = _crossed(_rare_first(others), ["pivot", "token"], (beside > 0) & (beside <= F.least("sharedx", "sharedy"))).where(F.col("c") + F.greatest(_missing("nx", "ox"), _missing("ny", "oy")) - 1 >= beside)
        done = star_pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        pairs = crossed.select("x", "y").unionByName(met.select("x", "y")).distinct().join(done, ["x", "y"], "left_anti")
        more, _ = _tested(written(pairs.withColumn("measured", F.lit(False)), "ngram-crossed"), active, shared, k)
        links = links.unionByName(more.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))
    links = links.unionByName(copies.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = components(links)

    # A copy takes its class's label; rows of several texts have become nodes of their own.
    near = copies.join(several, "doc_id", "left_anti").withColumnRenamed("rep", "node")
    far = near.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
    own = labels.select(F.col("node").alias("doc_id"), F.col("label").alias("component_id"))
    return written(far.unionByName(own), "ngram-components", lasting=True)


def ngram_join(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = written(base.mapInArrow(task(_profile(k)), "kind tinyint, doc_id long, n long, hi long, lo long"), "ngram-profile")
    rows = profile.where("kind = 0").drop("kind")
    often = profile.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_FREQUENCY).orderBy(F.desc("n"), "hi").limit(FREQUENT).toArrow()
    shared = spark.sparkContext.broadcast((often["hi"].to_numpy().astype(np.int64).view(np.uint64), often["n"].to_numpy().astype(np.int64)))

    with scratch(spark):
        ends = _ends(base, rows, shared, k)
    return rows.join(ends, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_deduplicated(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One row of each component, that of the smallest doc_id, with all columns. Rows without a doc_id stay."""
    found = written(ngram_join(docs, k).where("doc_id IS NOT NULL"), "ngram-found")
    drop = written(found.where("component_id != doc_id").select("doc_id").distinct(), "ngram-drop")
    again = written(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "ngram-again")
    out = without(docs, drop, "doc_id")
    if not again.isEmpty():
        out = without(out, again, "doc_id").unionByName(first_of_each(only(out, again, "doc_id"), ["doc_id"]))
    return out
