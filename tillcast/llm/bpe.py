"""Byte-level BPE with a public vocabulary: encode texts to ids, decode ids to bytes.

Pre-tokenisation uses no regular expression. Each code point has a class, and a
class with one symbol of look-ahead is a function on eight states. Functions compose
associatively, so a chunk is cut into columns whose functions are built side by side,
combined by a prefix scan, and replayed from the right start state; the replay says
where pieces begin. Pieces are then merged pair by pair, lowest rank first, through
a cache by piece.

The cut is that of the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
 ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
"""

from __future__ import annotations

import base64
import functools
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Chunk, col, read, small_batches, with_text_columns

CACHE = 1 << 17  # pieces remembered in a task; beyond it the cache starts anew
SIDE = 64  # pieces of up to so many bytes are merged side by side
IDS = 1 << 17  # ids decoded at once
LONG = 256  # pieces of more bytes are merged with a heap

# Code point classes
OTHER, LETTER, NUMBER, SPACE, WHITE, END = range(6)
# Symbols: class with look-ahead; those of a text's first code point are FIRST higher
_O, _L, _N, _SP, _WS, _WI, _Q2, _Q3, FIRST = range(9)
# States: nothing open, inside letters / numbers / others / white space, after a joining
# space, one or two letters of a contraction to come
_NONE, _IN_L, _IN_N, _IN_O, _IN_W, _JOIN, _C1, _C2, STATES = range(9)


@functools.cache
def _classes() -> np.ndarray:
    import regex
    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    at = np.array(points)
    every = "".join(map(chr, points))
    out = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            out[at[m.start():m.end()]] = kind
    out[32] = SPACE
    return out


@functools.cache
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a piece begins here", by symbol and state, both flat."""
    opens = {_O: _IN_O, _L: _IN_L, _N: _IN_N, _SP: _JOIN, _WS: _NONE, _WI: _IN_W, _Q2: _C1, _Q3: _C2}
    goes = {(_IN_L, _L): _IN_L, (_IN_N, _N): _IN_N, (_IN_W, _WI): _IN_W}
    for q in (_O, _Q2, _Q3):
        goes[_IN_O, q] = _IN_O
        goes[_JOIN, q] = _IN_O
    goes |= {(_JOIN, _L): _IN_L, (_JOIN, _N): _IN_N, (_C1, _L): _NONE, (_C2, _L): _C1}
    nxt = np.zeros((2 * FIRST, STATES), np.uint8)
    new = np.ones((2 * FIRST, STATES), bool)
    for sym, opened in opens.items():
        nxt[sym] = nxt[sym + FIRST] = opened
        for s in range(STATES):
            if (s, sym) in goes:
                nxt[sym, s] = goes[s, sym]
                new[sym, s] = False
    return nxt.ravel(), new.ravel()


def _symbols(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Symbol of each code point."""
    n = len(cps)
    cls = _classes()[cps]
    first = np.zeros(n + 2, bool)
    first[starts[:-1][starts[:-1] < n]] = True
    first[n:] = True
    nxt = np.append(cls[1:], END)
    nxt[first[1:n + 1]] = END
    white = (cls == SPACE) | (cls == WHITE)
    inner = (nxt == SPACE) | (nxt == WHITE) | (nxt == END)
    sym = np.array([_O, _L, _N, _SP, _WS], np.uint8)[cls]
    sym[white & inner] = _WI
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        ext = np.append(cps, [0, 0])
        a = np.where(first[quote + 1], 0, ext[quote + 1])
        b = np.where(first[quote + 1] | first[np.minimum(quote + 2, n + 1)], 0, ext[quote + 2])
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[quote[two]] = _Q2
        sym[quote[three]] = _Q3
    sym[first[:n]] += FIRST
    return sym


def piece_starts(cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where pieces begin, over texts joined end to end."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    nxt, new = _machine()
    columns = 1024 if n > 1 << 14 else max(1, n >> 4)
    rows = -(-n // columns)
    sym = np.zeros(rows * columns, np.intp)
    sym[:n] = _symbols(cps, starts)
    base = np.ascontiguousarray(sym.reshape(columns, rows).T) * STATES
    f = np.tile(np.arange(STATES, dtype=np.uint8), (columns, 1))
    for r in range(rows):  # each column's function, all columns together
        f = nxt[base[r][:, None] + f]
    step = 1
    while step < columns:  # prefix scan: functions of everything up to a column
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate(([_NONE], f[:-1, _NONE])).astype(np.uint8)
    for r in range(rows):  # replay; base becomes the flat index of (symbol, state before)
        base[r] += state
        state = nxt[base[r]]
    return np.flatnonzero(new[base].T.ravel()[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pairs:
    """Which two ids join, and to which id: sorted keys, looked up for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        got = sorted(((ranks[t[:i]] << 32) | ranks[t[i:]], r) for t, r in ranks.items()
                     for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        keys = np.array([k for k, _ in got], np.int64)
        self.none = np.int32(max(ranks.values()) + 1)
        bits = 18
        while True:  # a few keys share a slot
            self.shift = np.uint64(64 - bits)
            slot = self._slot(keys)
            order = np.argsort(slot, kind="stable")
            _, count = np.unique(slot[order], return_counts=True)
            if not len(count) or count.max() <= 8:
                break
            bits += 1
        self.depth = int(count.max()) if len(count) else 1
        nth = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
        self.keys = np.full((self.depth, 1 << bits), -1, np.int64)
        self.made = np.full((self.depth, 1 << bits), self.none, np.int32)
        self.keys[nth, slot[order]] = keys[order]
        self.made[nth, slot[order]] = np.array([r for _, r in got], np.int32)[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.intp)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each joined pair; ``none`` where the two do not join (or one is -1)."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[0, slot] == keys, self.made[0, slot], self.none)
        for d in range(1, self.depth):
            again = np.flatnonzero((out == self.none) & (self.keys[d, slot] >= 0))
            hit = again[self.keys[d, slot[again]] == keys[again]]
            out[hit] = self.made[d, slot[hit]]
        out[(a < 0) | (b < 0)] = self.none
        return out


class Encoder:
    """Encodes chunks; remembers the ids of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = Pairs(ranks)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._clear()

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Pieces of like length are merged side by side, one pair each a round."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces])
        for i in np.flatnonzero(size > SIDE).tolist():
            out[i] = self.merge(pieces[i])
        width = 8
        least = 0
        while width <= SIDE:
            own = np.flatnonzero((size > least) & (size <= width))
            least, now, width = width, width, width * 2
            if not len(own):
                continue
            raw = np.frombuffer(b"".join(pieces[i].ljust(now, b"\0") for i in own.tolist()), np.uint8).reshape(-1, now)
            place = np.arange(now)
            ids = np.where(place < size[own][:, None], self.bytes[raw], np.int32(-1))
            ids = np.hstack([ids, np.full((len(own), 1), -1, np.int32)])
            pair = self.pairs.join(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(own), now)
            place = np.arange(now + 1)
            while len(own):
                at = pair.argmin(axis=1)
                low = pair[np.arange(len(own)), at]
                done = low == self.pairs.none
                if done.any():
                    left = (ids >= 0).sum(axis=1)
                    for k in np.flatnonzero(done).tolist():
                        out[own[k]] = ids[k, :left[k]].tolist()
                    go = ~done
                    own, ids, pair, at, low = own[go], ids[go], pair[go], at[go], low[go]
                    if not len(own):
                        break
                row = np.arange(len(own))
                src = np.minimum(place + (place > at[:, None]), now)
                ids = np.take_along_axis(ids, src, axis=1)
                ids[row, at] = low
                pair = np.take_along_axis(np.hstack([pair, np.full((len(own), 1), self.pairs.none)]), src, axis=1)[:, :now]
                pair[row, at] = self.pairs.join(low, ids[row, at + 1])
                inner = np.flatnonzero(at)
                pair[inner, at[inner] - 1] = self.pairs.join(ids[inner, at[inner] - 1], low[inner])
        return out

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = array("I")
        self.at = array("q", [0])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is joined, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > LONG:
            return self._merge_long(piece)
        none = len(ranks) + 256
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0: no part starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (r := ranks.get(piece[a:end[b]])) is not None:
                heapq.heappush(heap, (r, a, b, end[b]))

        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue  # one of the two parts has changed
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and where each text's ids start (n + 1 places)."""
        whole, starts = chunk.chars()
        cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = piece_starts(cps, starts)
        cuts = [*begin.tolist(), len(whole)]
        pieces = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.number) > CACHE:
            self._clear()
        number, get = self.number, self.number.get
        which = np.fromiter(map(get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        unknown = np.flatnonzero(which < 0).tolist()
        fresh = list(dict.fromkeys([pieces[i] for i in unknown]))
        for p, ids in zip(fresh, self.merge_many([p.encode() for p in fresh])):
            number[p] = len(number)
            self.ids.extend(ids)
            self.at.append(len(self.ids))
        which[unknown] = [number[pieces[i]] for i in unknown]
        at = np.frombuffer(self.at, np.int64)
        size = np.diff(at)[which]
        to = np.cumsum(size)
        total = int(to[-1]) if len(to) else 0
        src = np.arange(total) + np.repeat(at[which] - (to - size), size)
        flat = np.frombuffer(self.ids, np.uint32)[src] if total else np.zeros(0, np.uint32)
        return flat, np.append(0, to)[np.searchsorted(begin, starts)]


def _shared(spark: SparkSession, path: str):
    """Ranks broadcast from the driver: tens of thousands of short strings, fixed by the vocabulary."""
    return spark.sparkContext.broadcast(load_ranks(path))


def _lists(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with ``ids array<int>``: the token ids of each whole text.

    A null or empty text gives an empty array. Special tokens are not recognised.
    A column of docs named ids is replaced; every row is kept.
    """
    shared = _shared(docs.sparkSession, vocabulary)

    def maker():
        encoder = Encoder(shared.value)

        def run(chunk: Chunk):
            flat, offsets = encoder.encode(chunk)
            return [_lists(flat.astype(np.int32), offsets, pa.int32())]
        return run

    return with_text_columns(docs, text, "ids array<int>", maker)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """tokens with ``decoded`` (bytes of the ids) and ``ids_le`` (ids as little-endian 32-bit words).

    A null array counts as empty; an id outside the vocabulary fails the task. Columns
    of those names are replaced; every row is kept.
    """
    shared = _shared(tokens.sparkSession, vocabulary)
    kept = [c for c in tokens.columns if c not in ("decoded", "ids_le")]
    src = tokens.select(*[col(c) for c in kept])
    at = kept.index(ids)
    small_batches(tokens.sparkSession)
    schema = T.StructType([*src.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("ids_le", T.BinaryType())])

    def run(batches):
        by_id = sorted((i, b) for b, i in shared.value.items())
        size = np.zeros(by_id[-1][0] + 2, np.int64)
        for i, b in by_id:
            size[i] = len(b)
        pool = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        place = np.concatenate(([0], np.cumsum(size)))
        known = np.zeros(len(size), bool)
        known[[i for i, _ in by_id]] = True
        for batch in batches:
            lists = batch.column(at)
            n = len(lists)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.concatenate(([0], np.cumsum(lengths)))
            done = 0
            while done < n:
                stop = int(np.searchsorted(cuts, cuts[done] + IDS, "right")) - 1
                stop = min(n, max(stop, done + 1))
                own = lists.slice(done, stop - done).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(own) and (own.min() < 0 or own.max() >= len(known) or not known[own].all()):
                    raise ValueError("an id is not in the vocabulary")
                width = size[own]
                to = np.cumsum(width)
                src_at = np.arange(int(to[-1]) if len(to) else 0) + np.repeat(place[own] - (to - width), width)
                raw = pool[src_at].tobytes()
                ends = np.append(0, to)[cuts[done:stop + 1] - cuts[done]].tolist()
                le = own.astype("<u4").tobytes()
                spots = (4 * (cuts[done:stop + 1] - cuts[done])).tolist()
                rows = batch.slice(done, stop - done)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary()),
                     pa.array([le[a:b] for a, b in zip(spots, spots[1:])], pa.binary())],
                    names=[*rows.schema.names, "decoded", "ids_le"])
                done = stop

    return src.mapInArrow(run, schema)


def tokenize(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count of each text and digests of its ids and of the bytes decoded from them."""
    tokens = encode(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), vocabulary).drop("text")
    back = decode(tokens, vocabulary)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return tokenize(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
