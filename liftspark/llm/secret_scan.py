"""Secret scans (5): pattern hits, and a randomness battery with false-discovery control.

Patterns (base): assignments of a password, secret, token or API key, access
keys that begin with AKIA, and long lower-case hexadecimal strings.

Battery: every run of 20 or more characters of ``A-Za-z0-9+/_=-`` with marks
of an encoding (a digit, or both cases) that no pattern hit touches is a
candidate. Its encoding is inferred (hexadecimal, base 32, base 62, base 64)
and three tests of that alphabet follow: chi-squared uniformity, Wald-
Wolfowitz runs about the middle symbol, and lag-1 serial correlation. Fisher's
method joins the three p-values; the more random a string looks, the smaller
the statistic.

False discoveries: the null is ordinary text. Its statistics come from all
long plain words of the corpus (runs of 16 or more letters of one case, with
or without a capital) in classes of length, counted while scanning and added
up in Spark, on top of fixed sets of joined common words and of path-like
strings. A candidate's p-value is the share of its class's null strings that
look at least as random. Where none does, and nowhere below it, it is the tail
of a log-normal distribution fitted to the lower half of the path-like
strings, so that no number of null strings bounds it from below. Benjamini-Hochberg at ``RATE`` over all candidates, with
p-values of a class weighted by its length (longer strings give the tests
more power), yields one bound per class. Only the two histograms, of
``len(CLASSES) * BINS`` cells, reach the driver.

Defined cases: null and empty texts have no spans; ``base_sha256`` is then
that of the empty string; repeated rows give a row each; null doc_ids stay;
long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .storage import written

KINDS = ("assign", "access", "hex")
RANDOM = "random"
RATE = 0.01
CLASSES = (16, 20, 24, 32, 40, 64, 128)  # least lengths
BINS = 80
FIXED = 2000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PLAIN = re.compile(r"[A-Z]?[a-z]{15,}|[A-Z]{16,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")

_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",  # letters of one case side by side, which sets words apart
}
_INDEX = {k: {c: i for i, c in enumerate(v)} for k, v in _ALPHABETS.items()}
_COMMON = "about after again before below between could every first found great house large learn never other place plant point right small sound spell still study their there these thing think three water where which world would write number people company language information".split()


def encoding(s: str) -> str:
    body = s.rstrip("=")
    if re.fullmatch(r"[0-9a-fA-F]+", body) and (body == body.lower() or body == body.upper()):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32"
    return "base62" if body.isalnum() else "base64"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def score(s: str, enc: str | None = None) -> float:
    """-2 log10 of the joined p-value under uniform randomness."""
    enc = enc or encoding(s)
    index = _INDEX[enc]
    body = s.rstrip("=").translate({45: 43, 95: 47}) if enc == "base64" else s.lower() if enc == "hex" else s
    x = np.array([index[c] for c in body if c in index], dtype=np.float64)
    n, m = len(x), len(index)
    if n < 8:
        return BINS - 1.0
    found = np.bincount(x.astype(np.int64), minlength=m)
    chi = float((found.astype(np.float64) ** 2).sum() * m / n - n)
    p = [0.5 * math.erfc((chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n) / math.sqrt(2))]
    high = x >= m / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    c = x - x.mean()
    power = float((c * c).sum())
    p.append(_normal_tail((float((c[1:] * c[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 2.0 ** (1 - n))
    half = -sum(math.log(max(v, 1e-300)) for v in p)  # half of Fisher's statistic, of 6 degrees of freedom
    logp = -half + math.log(1 + half + half * half / 2)
    return -2 * logp / math.log(10)


def statistic(s: str, enc: str | None = None) -> int:
    """Bin of the score; 0 looks most random."""
    return min(BINS - 1, int(score(s, enc)))


def length_class(n: int) -> int:
    return max((i for i, least in enumerate(CLASSES) if n >= least), default=0)


@lru_cache(maxsize=1)
def _fixed_null() -> tuple[np.ndarray, np.ndarray]:
    """Statistics of joined common words and of path-like strings, FIXED of each for each class of length; lower tails of the latter by bin."""
    tails = np.empty((len(CLASSES), BINS))
    out = np.zeros((len(CLASSES), BINS), dtype=np.int64)
    state = 12345
    for k, least in enumerate(CLASSES):
        for _ in range(FIXED):
            s = ""
            while len(s) < least:
                state = (state * 1103515245 + 12345) % 2**31
                w = _COMMON[state // 65536 % len(_COMMON)]
                s += w.capitalize() if state // 4096 % 2 else w
            out[k, statistic(s, "base62")] += 1
        scores = np.empty(FIXED)
        for i in range(FIXED):
            s = ""
            while len(s) < least:
                state = (state * 1103515245 + 12345) % 2**31
                w = _COMMON[state // 65536 % len(_COMMON)]
                state = (state * 1103515245 + 12345) % 2**31
                s += ("/", "_", "-", "/", "")[state // 65536 % 5] + (w.capitalize() if state // 4096 % 2 else w)
                s += str(state // 1024 % 2030) if state // 2**28 % 4 == 0 else ""
            scores[i] = score(s)
            out[k, statistic(s)] += 1
        x = np.log1p(scores)
        middle = float(np.median(x))
        spread = float(np.sqrt(np.mean((x[x < middle] - middle) ** 2)))
        tails[k] = [0.5 * math.erfc((middle - math.log(t + 2)) / spread / math.sqrt(2)) for t in range(BINS)]
    return out, tails


def bounds(null: np.ndarray, candidates: np.ndarray, rate: float = RATE) -> list[int]:
    """For each class the largest bin that is a discovery, or -1."""
    fixed, tails = _fixed_null()
    null = null + fixed
    below = np.cumsum(null, axis=1)
    p = np.where(below > 0, np.maximum((1 + below) / (1 + null.sum(axis=1, keepdims=True)), tails), tails)
    weight = np.log2(np.array(CLASSES, dtype=np.float64))[:, None]
    total = candidates.sum()
    if not total:
        return [-1] * len(CLASSES)
    weight = weight * total / (candidates.sum(axis=1, keepdims=True) * weight).sum()
    q = np.minimum(1, p / weight)
    order = np.argsort(q, axis=None, kind="stable")
    values, found = q.ravel()[order], np.cumsum(candidates.ravel()[order])
    # Equal values stand or fall together.
    last = np.append(values[1:] != values[:-1], True)
    good = last & (values * total <= rate * np.maximum(found, 1)) & (found > 0)
    cut = values[np.flatnonzero(good)[-1]] if good.any() else -1.0
    return [int(np.flatnonzero(q[k] <= cut)[-1]) if (q[k] <= cut).any() else -1 for k in range(len(CLASSES))]


def _spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern hits, by start and kind."""
    out = []
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if b"akia" in low else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int8())), ("classes", pa.list_(pa.int8())), ("bins", pa.list_(pa.int16())), ("null_counts", pa.list_(pa.int32()))])
    for b in batches:
        keys, column = b["doc_id"].to_pylist(), b["text"]
        for i, j, buf, offsets in textvec.blocks(column):
            run = _RUN[buf]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], run.view(np.int8), [0]))))
            long = (edge[1::2] - edge[::2]) >= 16
            # A run may reach over the borders of texts; all that it touches are looked at.
            touched = np.zeros(j - i + 1, dtype=np.int64)
            np.add.at(touched, np.searchsorted(offsets, edge[::2][long], side="right") - 1, 1)
            np.add.at(touched, np.searchsorted(offsets, edge[1::2][long] - 1, side="right"), -1)
            has_run = np.cumsum(touched)[:-1] > 0
            raw = buf.tobytes()
            rows, null = [], np.zeros((len(CLASSES), BINS), dtype=np.int64)
            for k in range(i, j):
                data = raw[offsets[k - i] : offsets[k - i + 1]]
                low = data.lower()
                if not has_run[k - i] and not any(w in low for w in _WORDS):
                    rows.append((keys[k], [], [], [], [], [], []))
                    continue
                text = data.decode("utf-8")
                base = _spans(text, low)
                row = [[s, e, kind, -1, -1] for s, kind, e in base]
                for m in _LONG.finditer(text):
                    s = m[0]
                    if _PLAIN.fullmatch(s):
                        null[length_class(len(s)), statistic(s, "base62")] += 1
                    elif len(s) >= 20 and (any(map(str.isdigit, s)) or (s != s.lower() and s != s.upper())) and not any(a < m.end() and m.start() < e for a, _, e in base):
                        row.append([m.start(), m.end(), len(KINDS), length_class(len(s)), statistic(s)])
                rows.append((keys[k], *zip(*row, strict=True), []) if row else (keys[k], [], [], [], [], [], []))
            if null.any() and rows:
                rows[-1] = (*rows[-1][:-1], null.ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, x)) if f.name != "doc_id" else list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _finish(limits: list[int]):
    names = (*KINDS, RANDOM)
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, starts, ends, kinds, classes, bins in zip(*(b[c].to_pylist() for c in ("doc_id", "starts", "ends", "kinds", "classes", "bins")), strict=True):
                found = sorted((s, k, e) for s, e, k, c, t in zip(starts, ends, kinds, classes, bins, strict=True) if c < 0 or t <= limits[c])
                told = [f"{names[k]}:{s}:{e}" for s, k, e in found]
                base = ",".join(x for x, (_, k, _) in zip(told, found, strict=True) if k < len(KINDS))
                rows.append((key, *(sum(k == n for _, k, _ in found) for n in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(told)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return run


def secret_scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(base.mapInArrow(_scan, "doc_id long, starts array<int>, ends array<int>, kinds array<tinyint>, classes array<tinyint>, bins array<smallint>, null_counts array<int>"), "secret-scan")
    cells = len(CLASSES) * BINS
    null = np.zeros(cells, dtype=np.int64)
    for r in scanned.select(F.posexplode("null_counts").alias("cell", "n")).where("n > 0").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        null[r["cell"]] = r["n"]
    found = np.zeros(cells, dtype=np.int64)
    zipped = scanned.select(F.explode(F.arrays_zip("classes", "bins")).alias("c")).where("c.classes >= 0")
    for r in zipped.groupBy((F.col("c.classes") * BINS + F.col("c.bins")).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["cell"]] = r["n"]
    limits = bounds(null.reshape(-1, BINS), found.reshape(-1, BINS), rate)
    return scanned.mapInArrow(_finish(limits), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
