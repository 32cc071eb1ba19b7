"""Byte-level BPE encoding and decoding (2): a lazily determinised transducer.

A text is cut into pieces by the split pattern of the rank files, here as
class changes over all code points of a block at once. Each piece goes
through a finite-state transducer compiled from the ranks. Its states hold
the places where the next token may still begin: for each, the trie node
reached since, the last token before it, and the tokens not yet emitted. One
byte advances every place; where a trie node is a token that may follow the
last one (the two, encoded together, stay two), the place behind it becomes a
new beginning, and there is exactly one for each prefix. What all live
beginnings have in common is emitted, so the output lags by at most the
longest token. States and transitions are made when first met and kept in
tables of bounded size; the later half go when those are full.

A piece that is itself in the rank file is that token, as in the usual
encoder. Results of pieces are kept in a direct-mapped table of fixed size
under their hashes; a block whose tokens don't spell its bytes piece by piece
(two pieces had one hash) is encoded again without the table. The pieces that
the table lacks take their steps through the transducer together.

Decoding looks tokens up in a byte pool, chunk by chunk; an incremental
UTF-8 state machine lets out whole characters and holds an unfinished one
until its bytes arrive. Encoding documents decodes each again, compares every
byte, and raises if one differs.

Defined cases: a null text counts as empty and has no tokens; empty tables
give empty results; repeated rows give a row each; null doc_ids stay; texts
of any length are cut only between pieces; a token that many texts share is
nothing special (there are no ties to break); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .storage import small_batches
from .textvec import mix
from .workers import hold, task

BLOCK = 1 << 16  # bytes worked on at once
MAX_STATES = 240_000
MAX_PAIRS = 50_000
SLOTS_BITS = 19
MAX_POOL = 1 << 20  # token ids kept for pieces, 4 bytes each
CHUNK = 1 << 16  # tokens decoded at once

LOCKSTEP = 64  # bytes; longer pieces are encoded one by one

_U = np.uint64
_SPREAD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_pair_by_pair(ranks: dict[bytes, int], piece: bytes, below: int = 1 << 60) -> list[int]:
    """The plain rule: merge the adjacent pair of lowest rank, leftmost first, until none is left of a rank below ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        best = found.index(min(found))
        if found[best] >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Table:
    """Numbers by 64-bit keys other than 0: open addressing in two arrays, half full at most."""

    def __init__(self, size: int = 1 << 14):
        self.keys, self.values, self.n = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int64), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _U(_SPREAD) >> _U(65 - len(self.keys).bit_length())).astype(np.int64)

    def many(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of these keys, -1 where there is none."""
        slot, last = self._slots(keys), len(self.keys) - 1
        held = self.keys[slot]
        found = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = at = (slot[left] + 1) & last
            held, want = self.keys[at], keys[left]
            hit = held == want
            found[left[hit]] = self.values[at[hit]]
            left = left[~hit & (held != 0)]
        return found

    def keep(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            was, size = (self.keys[full], self.values[full]), len(self.keys)
            while 2 * (self.n + len(keys)) > size:
                size *= 2
            self.__init__(size)
            self.keep(*was)
        self.n += len(keys)
        slot, last = self._slots(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):  # each free place goes to one of those that want it
            at = slot[left]
            free = self.keys[at] == 0
            won = left[free]
            self.keys[at[free]] = keys[won]
            lost = self.keys[at] != keys[left]
            kept = left[~lost]
            self.values[slot[kept]] = values[kept]
            left = left[lost]
            slot[left] = (slot[left] + 1) & last

    def where(self, keep) -> Table:
        """What ``keep`` holds true of, given all keys and numbers."""
        full = self.keys != 0
        keys, values = self.keys[full], self.values[full]
        kept, out = keep(keys, values), Table()
        out.keep(keys[kept], values[kept])
        return out

    def place(self, key: int) -> int:
        """Where one key stands, or would stand."""
        keys, last = self.keys, len(self.keys) - 1
        slot = (key * _SPREAD & _ALL) >> (65 - len(keys).bit_length())
        while (held := int(keys[slot])) and held != key:
            slot = (slot + 1) & last
        return slot


class Numbered:
    """Distinct byte strings, numbered as they come, in one pool. Two of one hash may get a number each time they come."""

    def __init__(self) -> None:
        self.pool, self.ends, self.table = bytearray(), array("q", [0]), Table()

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> bytes:
        return bytes(self.pool[self.ends[i] : self.ends[i + 1]])

    def number(self, key: bytes) -> int:
        t, h = self.table, hash(key) & _ALL or 1
        at = t.place(h)
        if met := int(t.keys[at]):
            i = int(t.values[at])
            if self[i] == key:
                return i
        n = len(self)
        self.pool += key
        self.ends.append(len(self.pool))
        if not met:
            t.keep(np.array([h], dtype=np.uint64), np.array([n])) if 2 * t.n + 2 > len(t.keys) else self._put(at, h, n)
        return n

    def cut(self, n: int) -> None:
        """Only the first n stay."""
        del self.pool[self.ends[n] :]
        del self.ends[n + 1 :]
        self.table = self.table.where(lambda _, values: values < n)

    def _put(self, at: int, h: int, n: int) -> None:
        self.table.keys[at], self.table.values[at] = h, n
        self.table.n += 1


class Transducer:
    """Encodes one piece; deterministic states are made as inputs need them.

    A state is one row of integers: for each live beginning the tokens not yet
    emitted, how many these are, the last token, and the trie node, so that it
    is read from its end. One beginning stands behind all bytes read; its
    tokens are emitted where a piece ends. Moves stand in a hash table in
    arrays, so that many pieces take a step at once. When there are more than
    ``most`` states the later half are dropped, and made again as needed."""

    def __init__(self, ranks: dict[bytes, int], most: int | None = None):
        self.most = most or MAX_STATES
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.trie: dict[int, int] = {}
        self.token: dict[int, int] = {}  # trie node -> token
        nodes = 1
        for b, r in ranks.items():
            node = 0
            for x in b:
                key = node << 8 | x
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = nodes
                    nodes += 1
                node = nxt
            self.token[node] = r
        self.halves: dict[int, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states, self.outs = Numbered(), Numbered()
        self.outs.number(b"")
        self.finals = array("q")  # state -> what is emitted at a piece's end
        self.moves = Table(1 << 16)  # state << 8 | byte, plus one -> what is emitted << 32 | next state
        self._state([0, -1, 0], [])

    def _forget_late(self) -> None:
        """Drops the states met last: those that many pieces pass through are met early."""
        n = self.most // 2
        outs = max(self.finals[:n]) + 1
        self.states.cut(n)
        self.outs.cut(outs)
        del self.finals[n:]
        self.moves = self.moves.where(lambda keys, values: (keys - _U(1) >> _U(8) < n) & (values & 0xFFFFFFFF < n) & (values >> 32 < outs))

    def _state(self, flat: list[int], final: list[int]) -> int:
        state = self.states.number(_pack(flat))
        if state == len(self.finals):
            self.finals.append(self.outs.number(_pack(final)))
        return state

    def _halves(self, t: int) -> tuple[int, ...]:
        """The two tokens whose merge makes this one; none of a single byte, and (-1,) if its bytes merge to something else."""
        if (got := self.halves.get(t)) is None:
            parts = merge_pair_by_pair(self.ranks, self.bytes_of[t], t)
            got = () if len(self.bytes_of[t]) == 1 else (parts[0], parts[1]) if len(parts) == 2 and self.ranks.get(self.bytes_of[parts[0]] + self.bytes_of[parts[1]]) == t else (-1,)
            self.halves[t] = got
        return got

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a: no merge across their border comes before those that make them.

        At the border stands one token at a time of those that end a, and of those that begin b. A merge of two
        goes ahead if its rank is below that of the merge that takes up the left one (of equal merges the leftmost
        is first), and not above that of the merge that takes up the right one."""
        key = a << 32 | b
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            x, y, taken_x, taken_y, ok = a, b, 1 << 60, 1 << 60, True
            while True:
                merged = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if merged is not None and merged < taken_x and merged <= taken_y:
                    ok = False
                    break
                # Before the younger of the two there was its half.
                left, right = self._halves(x), self._halves(y)
                if left and (x > y or not right):
                    x, taken_x = left[1], x
                elif right:
                    y, taken_y = right[0], y
                else:
                    break
            self.pairs[key] = ok
        return ok

    def _move(self, state: int, byte: int) -> int:
        live, reached = [], None
        s = _unpack(self.states[state])
        i = len(s)
        n = 1 << 30
        while i:
            node, last, k = s[i - 1], s[i - 2], s[i - 3]
            i -= 3 + k
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            pending = s[i : i + k]
            live.append((child, last, pending))
            if k < n:
                n, common = k, pending
            if reached is None:
                t = self.token.get(child)
                if t is not None and self._halves(t) != (-1,) and (last < 0 or self._follows(last, t)):
                    reached = pending + [t]
                    ending = (0, t, reached)
        if reached is None:
            raise ValueError("the ranks lack a single byte")
        if len(live) == 1 and len(reached) <= n:
            n, common = len(reached), reached
        live.append(ending)
        if n:
            for _, _, p in live:
                while p[:n] != common[:n]:
                    n -= 1
        flat: list[int] = []
        for node, last, p in live:
            flat += p[n:]
            flat += (len(p) - n, last, node)
        return self.outs.number(_pack(common[:n])) << 32 | self._state(flat, reached[n:])

    def _moved(self, keys: np.ndarray) -> np.ndarray:
        """Moves of these keys; those not met before are made."""
        found = self.moves.many(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            u, back = np.unique(keys[new], return_inverse=True)
            made = np.fromiter((self._move(k >> 8, k & 255) for k in (u - _U(1)).tolist()), dtype=np.int64, count=len(u))
            self.moves.keep(u, made)
            found[new] = made[back]
        return found

    def _tokens(self, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a row of emissions, and how many each has."""
        ends = np.array(self.outs.ends) >> 2
        first = ends[outs]
        k = ends[outs + 1] - first
        total = np.cumsum(k)
        flat = np.frombuffer(self.outs.pool, dtype=np.int32)  # must go before the pool grows again
        tokens = flat[np.repeat(first - (total - k), k) + np.arange(int(total[-1]) if len(total) else 0)]
        del flat
        return tokens.astype(np.uint32), k

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece, byte by byte."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out: list[int] = []
        state = 0
        for a in range(0, len(piece), 1 << 16):
            for byte in piece[a : a + (1 << 16)]:
                move = int(self._moved(np.array([(state << 8 | byte) + 1], dtype=np.uint64))[0])
                state = move & 0xFFFFFFFF
                out += _unpack(self.outs[move >> 32])
                if len(self.states) > self.most:
                    flat, final = _unpack(self.states[state]), _unpack(self.outs[self.finals[state]])
                    self._forget_late()
                    state = self._state(flat, final)
        return out + _unpack(self.outs[self.finals[state]])

    def encode_many(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pieces, and how many each has: all pieces take a step at a time."""
        size = ends - starts
        if not len(size):
            return np.empty(0, dtype=np.uint32), size
        if len(self.states) > self.most:
            self._forget_late()
        order = np.argsort(-size, kind="stable")
        start, size = starts[order], size[order]
        state = np.zeros(len(size), dtype=np.int64)
        rows, outs = [], []
        active = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
        for j, m in enumerate(active.tolist()):
            move = self._moved((state[:m] << 8 | buf[start[:m] + j]).astype(np.uint64) + _U(1))
            state[:m] = move & 0xFFFFFFFF
            told = move >> 32
            some = np.flatnonzero(told)
            rows.append(order[some])
            outs.append(told[some])
        rows.append(order)
        outs.append(np.array(self.finals)[state])
        row, out = np.concatenate(rows), np.concatenate(outs)
        by_row = np.argsort(row, kind="stable")
        tokens, k = self._tokens(out[by_row])
        return tokens, np.bincount(row[by_row], weights=k, minlength=len(size)).astype(np.int64)


def _pack(flat: list[int]) -> bytes:
    return array("i", flat).tobytes()


def _unpack(key: bytes) -> list[int]:
    return memoryview(key).cast("i").tolist()


def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    table = np.zeros(0x110000, dtype=np.uint8)
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            a, b = points[m.start()], points[m.end() - 1]
            table[a : b + 1] = value
    table[_WHITE] = 3
    return table


class Codec:
    """Encodes and decodes blocks of texts."""

    def __init__(self, path: str, most: int | None = None):
        ranks = load_ranks(path)
        self.fst = Transducer(ranks, most)
        self.classes = _classes()
        self.bytes = mix(np.arange(1001, 1257, dtype=np.uint64))
        top = max(ranks.values()) + 1
        self.lengths = np.zeros(top, dtype=np.int64)
        pool = bytearray()
        self.at = np.zeros(top, dtype=np.int64)
        for b, r in ranks.items():
            self.at[r], self.lengths[r] = len(pool), len(b)
            pool += b
        self.pool = np.frombuffer(bytes(pool), dtype=np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << SLOTS_BITS, dtype=np.uint64)
        self.where = np.zeros(1 << SLOTS_BITS, dtype=np.int32)
        self.size = np.zeros(1 << SLOTS_BITS, dtype=np.int32)
        self.kept = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte places where the pieces of a block begin, closed by the block's length."""
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        n = len(points)
        if not n:
            return np.zeros(1, dtype=np.int64)
        ascii_only = n == len(buf)
        at = np.arange(n + 1) if ascii_only else np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
        edges = np.searchsorted(at, offsets)  # code points where texts begin
        c = self.classes[points]
        new = np.ones(n, dtype=bool)
        new[1:] = c[1:] != c[:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[edges] = True
        new |= edge[:n]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], n)
        starts = new.copy()
        space = c[runs] == 3
        ahead = space & ~edge[ends]  # white space before something else in the same text
        last = ends[ahead] - 1
        starts[last] = True
        joined = last[points[last] == 0x20]
        starts[joined + 1] = False
        mark = runs[(c[runs] == 0) & (ends - runs == 1)]
        mark = mark[(points[mark] == 0x27) & starts[mark]]
        if len(mark):
            for p in mark[~edge[mark + 1]].tolist():
                tail = "".join(map(chr, points[p + 1 : p + 3].tolist()))
                size = 2 if tail[:1] in ("s", "t", "m", "d") and tail else 3 if tail in ("re", "ve", "ll") else 0
                if size and not edge[p + 1 : p + size].any():
                    starts[p + 1] = False
                    if p + size < n:
                        starts[p + size] = True  # what follows begins anew, be it the rest of the letters or another run
        return at[np.append(np.flatnonzero(starts), n)]

    def block(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a block, and for each text the place of its first token."""
        if not len(buf):
            return np.empty(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        if self.used > MAX_POOL:
            self._clear()
        at = self.pieces(buf, offsets)
        textvec._grown(len(buf))
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.bytes[buf] * textvec._POW[: len(buf)], out=sums[1:])
        h = mix((sums[at[1:]] - sums[at[:-1]]) * textvec._INV[at[:-1]]) | np.uint64(1)
        slot = (h >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        where, size = self.where[slot].astype(np.int64), self.size[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            u, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            flat, n = self._encoded(buf, at[missed[first]], at[missed[first] + 1])
            w = self.used + np.cumsum(n) - n
            if self.used + len(flat) > len(self.kept):
                self.kept = np.concatenate([self.kept[: self.used], np.zeros(max(len(flat), len(self.kept)), dtype=np.uint32)])
            self.kept[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            where[missed], size[missed] = w[back], n[back]
            s = slot[missed[first]]
            # Where new pieces share a slot all three tables must get the same one.
            _, one = np.unique(s, return_index=True)
            self.keys[s[one]], self.where[s[one]], self.size[s[one]] = u[one], w[one], n[one]
        total = np.cumsum(size)
        begin = total - size
        ids = self.kept[np.repeat(where - begin, size) + np.arange(int(total[-1]))]
        length = np.cumsum(self.lengths[ids])
        if not (np.array_equal(length[total - 1], at[1:]) and np.array_equal(self.raw(ids), buf)):
            # Two pieces share a hash: each of this block's pieces is encoded by itself.
            ids, size = self._encoded(buf, at[:-1], at[1:])
            total = np.cumsum(size)
            begin = total - size
        bounds = np.append(begin, total[-1])[np.searchsorted(at, offsets)]
        return ids, bounds

    def _encoded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces, and how many each has."""
        whole, known, n_bytes = buf.tobytes(), self.fst.ranks.get, ends - starts
        one = np.fromiter((known(whole[a:b], -1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(starts))
        size = np.ones(len(starts), dtype=np.int64)
        parts, rows = [one[one >= 0].astype(np.uint32)], [np.flatnonzero(one >= 0)]
        short = np.flatnonzero((one < 0) & (n_bytes <= LOCKSTEP))
        for a in range(0, len(short), 1 << 13):
            part = short[a : a + (1 << 13)]
            tokens, size[part] = self.fst.encode_many(buf, starts[part], ends[part])
            parts.append(tokens)
            rows.append(np.repeat(part, size[part]))
        for i in np.flatnonzero((one < 0) & (n_bytes > LOCKSTEP)).tolist():
            tokens = np.array(self.fst.encode(whole[starts[i] : ends[i]]), dtype=np.uint32)
            size[i] = len(tokens)
            parts.append(tokens)
            rows.append(np.full(len(tokens), i))
        return np.concatenate(parts)[np.argsort(np.concatenate(rows), kind="stable")], size

    def long_text(self, buf: np.ndarray) -> Iterator[np.ndarray]:
        """Token ids of one text, part by part; parts end before a space between ASCII letters."""
        lo, n = 0, len(buf)
        while lo < n:
            hi = lo
            cut = n
            while hi < n:
                was, hi = max(hi, lo + 1), min(n, hi + BLOCK)
                if hi == n:
                    break
                b = buf[was:hi]
                letter = ((b | 0x20) >= 97) & ((b | 0x20) <= 122)
                good = np.flatnonzero((b[1:-1] == 0x20) & letter[:-2] & letter[2:])
                if len(good):
                    cut = was + int(good[-1]) + 1
                    break
            part = buf[lo:cut]
            yield self.block(part, np.array([0, len(part)]))[0]
            lo = cut

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, token ids) for every row, in order."""
        for i, j, buf, offsets in textvec.blocks(column, BLOCK):
            if j == i + 1 and len(buf) > BLOCK:
                yield i, np.concatenate(list(self.long_text(buf)))
                continue
            ids, bounds = self.block(buf, offsets)
            for k in range(i, j):
                yield k, ids[bounds[k - i] : bounds[k - i + 1]]

    def raw(self, ids: np.ndarray) -> np.ndarray:
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return np.empty(0, dtype=np.uint8)
        n = self.lengths[ids]
        total = np.cumsum(n)
        return self.pool[np.repeat(self.at[ids] - (total - n), n) + np.arange(int(total[-1]))]

    def decode(self, chunks: Iterable[np.ndarray]) -> Iterator[bytes]:
        """Bytes of a stream of token ids; each part ends with a whole character, as far as the bytes are UTF-8."""
        machine = Utf8Machine()
        for ids in chunks:
            for a in range(0, len(ids), CHUNK):
                yield machine.feed(self.raw(ids[a : a + CHUNK]).tobytes())
        yield machine.close()


class Utf8Machine:
    """Holds the unfinished character at the end of a byte stream until its other bytes come.

    ``_STATE[byte]`` is how many bytes a character that begins with it still
    needs; a byte that can't begin or go on with one is let through as it is."""

    _STATE = [0] * 0xC2 + [1] * 30 + [2] * 16 + [3] * 5 + [0] * 11

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if 0x80 <= byte < 0xC0:
                continue
            if self._STATE[byte] >= back:
                self.held = data[-back:]
                return data[:-back]
            break
        self.held = b""
        return data

    def close(self) -> bytes:
        data, self.held = self.held, b""
        return data


def codec(path: str, most: int | None = None) -> Codec:
    """The worker's codec for these ranks."""
    return hold(("bpe", path, most), lambda: Codec(path, most))


def _decoded(c: Codec, ids: np.ndarray, text: np.ndarray) -> str:
    """SHA-256 of the decoded bytes, which must be those of the text."""
    h, at = hashlib.sha256(), 0
    for part in c.decode([ids]):
        if not np.array_equal(np.frombuffer(part, dtype=np.uint8), text[at : at + len(part)]):
            raise ValueError("decoding doesn't give the text")
        h.update(part)
        at += len(part)
    if at != len(text):
        raise ValueError("decoding doesn't give the whole text")
    return h.hexdigest()


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, states: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on demand, token_ids (little-endian unsigned 32-bit integers).

    ``states`` bounds the transducer's table (MAX_STATES by default): fewer take less memory and more time."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, states)
        arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("token_ids", pa.binary())] * with_ids)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for b in batches:
            keys = b["doc_id"].to_pylist()
            whole, offsets = textvec.utf8(b["text"])
            rows, held = [], 0
            for k, ids in c.encode(b["text"]):
                packed = ids.astype("<u4", copy=False).tobytes()
                row = (keys[k], len(ids), hashlib.sha256(packed).hexdigest(), _decoded(c, ids, whole[offsets[k] : offsets[k + 1]]))
                rows.append((*row, packed) if with_ids else row)
                held += len(packed) if with_ids else 100
                if held > 1 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task(run, holds=True), schema)
