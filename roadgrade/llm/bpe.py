"""Byte-level BPE: encoding and decoding of whole texts.

Text is cut into pieces without a regular expression. Each code point gets a symbol: its class (letter, number, other,
white space) and what can be seen just ahead of it (whether white space ends here, whether an apostrophe opens a
contraction). A symbol is a function on the states of a small automaton; such functions compose associatively, so
fixed blocks of text are composed side by side, the blocks' functions are chained, and a second sweep over all blocks
at once marks where pieces begin. Each piece then goes through the merges once and is cached.
"""

from __future__ import annotations

import base64
import gc
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text

LETTER, NUMBER, OTHER, SPACE = range(4)
# symbols: letter, number, other, apostrophe of a contraction of 1 or 2 letters, white space that goes on (or ends the
# text), a last space (joins what follows), other last white space
(S_L, S_N, S_O, S_A1, S_A2, S_MID, S_LAST, S_CUT) = range(8)
# states: nothing open, in letters, in numbers, in others, after a joining space, in white space, 1 or 2 letters of a contraction to come
(FREE, IN_L, IN_N, IN_O, JOIN, IN_W, C1, C2) = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece begin here) by symbol and state."""
    to, new = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for sym, inside in ((S_L, IN_L), (S_N, IN_N), (S_O, IN_O)):
        to[sym] = inside
        new[sym, [inside, JOIN]] = False
    to[S_L, C1], to[S_L, C2] = FREE, C1
    new[S_L, [C1, C2]] = False
    for sym, state in ((S_A1, C1), (S_A2, C2)):
        to[sym] = state
        to[sym, [IN_O, JOIN]] = IN_O
        new[sym, [IN_O, JOIN]] = False
    to[S_MID], to[S_LAST], to[S_CUT] = IN_W, JOIN, FREE
    new[S_MID, IN_W] = False
    return to, new


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    # White_Space of the Unicode character database
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = SPACE
    return out


def piece_starts(codes: np.ndarray, first: np.ndarray, block: int = 512) -> np.ndarray:
    """Mask of the code points at which a piece begins. first: mask of the texts' first code points."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, bool)
    kind = _classes()[codes]
    ends = np.append(first[1:], True)  # a text's last code point
    ahead = lambda x, k: np.concatenate([x[k:], np.zeros(min(k, n), x.dtype)])
    sym = kind.copy()
    space = kind == SPACE
    last = space & ~ends & (ahead(kind, 1) != SPACE)
    sym[space] = S_MID
    sym[last] = np.where(codes[last] == 32, S_LAST, S_CUT)
    q = np.flatnonzero(codes == 39)
    if len(q):
        stop = np.cumsum(first)
        at = lambda k: np.where((q + k < n) & (stop[np.minimum(q + k, n - 1)] == stop[q]), codes[np.minimum(q + k, n - 1)], 0)
        one, two = at(1), at(2)
        sym[q[np.isin(one, [ord(c) for c in "stmd"])]] = S_A1
        pair = np.zeros(len(q), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        sym[q[pair]] = S_A2
    to, new = _automaton()
    # a text's first symbol maps every state to what it makes of the free one
    to = np.concatenate([to, np.repeat(to[:, :1], 8, axis=1), np.arange(8, dtype=np.uint8)[None]])
    new = np.concatenate([new, np.ones((8, 8), bool), np.zeros((1, 8), bool)])
    sym = sym + 8 * first.astype(np.uint8)
    rows = -(-n // block)
    grid = np.full(rows * block, 16, np.uint8)  # 16: no change
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    flat = to.ravel()
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for column in grid:  # compose each block's functions, all blocks side by side
        maps = flat[column[:, None].astype(np.int16) * 8 + maps]
    state = np.empty(rows, np.uint8)
    now = FREE
    for i, m in enumerate(maps.tolist()):  # chain the blocks
        state[i] = now
        now = m[now]
    begins, starts = new.ravel(), np.empty((block, rows), bool)
    for k, column in enumerate(grid):
        code = column.astype(np.int16) * 8 + state
        starts[k], state = begins[code], flat[code]
    return starts.T.ravel()[:n]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: No rank.
NONE = np.iinfo(np.int32).max


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank is merged first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    rank, none = ranks.get, 1 << 60
    pair = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair and (least := min(pair)) < none:
        i = pair.index(least)
        parts[i] += parts[i + 1]
        del parts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = rank(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = rank(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links, for very long pieces."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i] = a + b
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for i, p in enumerate(parts) if not gone[i]]


class Merger:
    """Merges many pieces side by side: in each round every piece merges its adjacent pair of least rank, the leftmost of
    equals, until none has one left."""

    WIDEST = 32  #: bytes of the longest pieces that are merged side by side

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        if len(ranks) >= 1 << 31 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the file of ranks lacks a byte")
        keys, to = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a << 32 | b)
                    to.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pair = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.to = np.append(np.array(to, np.int32)[order], NONE)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make; NONE if they make none or one of them is -1."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.searchsorted(self.pair, key)
        at[key < 0] = len(self.pair) - 1
        return np.where(self.pair[at] == key, self.to[at], NONE)

    def __call__(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [(r,) if (r := self.ranks.get(p)) is not None else None for p in pieces]
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if out[i] is None:
                wide = next((w for w in (8, 12, 16, self.WIDEST) if len(p) <= w), 0)
                if wide:
                    by_width.setdefault(wide, []).append(i)
                else:
                    out[i] = tuple(merge(p, self.ranks))
        for wide, at in by_width.items():
            for low in range(0, len(at), 1 << 15):
                some = at[low : low + (1 << 15)]
                for i, ids in zip(some, self._side_by_side([pieces[i] for i in some], wide), strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], wide: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(wide) < size[:, None]
        ids = np.full((n, wide), -1, np.int32)
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy()  # the next token's place
        before = after - 2
        rank = np.full((n, wide), NONE, np.int32)  # of the pair that begins here
        pairs = inside[:, 1:]
        rank[:, :-1][pairs] = self.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        alive, rows = inside, np.arange(n)
        while len(rows):
            i = rank[rows].argmin(axis=1)
            least = rank[rows, i]
            some = least < NONE
            rows, i, least = rows[some], i[some], least[some]
            j = after[rows, i]
            k = after[rows, j]  # the one after the pair
            ids[rows, i] = least
            alive[rows, j] = False
            rank[rows, j] = NONE
            after[rows, i] = k
            more = k < size[rows]
            before[rows[more], k[more]] = i[more]
            rank[rows, i] = NONE
            rank[rows[more], i[more]] = self.rank(least[more], ids[rows[more], k[more]])
            h = before[rows, i]
            less = h >= 0
            rank[rows[less], h[less]] = self.rank(ids[rows[less], h[less]], least[less])
        flat = ids[alive].tolist()
        edge = np.cumsum(np.concatenate([[0], alive.sum(axis=1)])).tolist()
        return [tuple(flat[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


@lru_cache(4)  # the cache of pieces lasts as long as the Python worker
def _encoder(path: str, offsets: bool = True) -> Callable[[list, list], dict]:
    merger = Merger(read_ranks(path))
    cache: dict[str, tuple[int, ...]] = {}

    def encode(ids: list, texts: list) -> dict:
        gc.disable()  # nothing here is cyclic; scans of the growing cache would take half the time
        try:
            return cut_and_merge(ids, texts)
        finally:
            gc.enable()

    def cut_and_merge(ids: list, texts: list) -> dict:
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        at = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(codes), bool)
        first[at[:-1][lengths > 0]] = True
        starts = np.flatnonzero(piece_starts(codes, first))
        edges = np.append(starts, len(codes)).tolist()
        pieces = [whole[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        fresh = list(set(pieces).difference(cache))
        cache.update(zip(fresh, merger([p.encode("utf-8", "surrogatepass") for p in fresh]), strict=True))
        found = [cache[p] for p in pieces]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        tokens = np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum()))
        piece_at = np.searchsorted(starts, at)  # pieces before each text
        token_at = np.concatenate([[0], np.cumsum(counts)])[piece_at]
        rel = starts - np.repeat(at[:-1], np.diff(piece_at))
        if len(cache) > 150_000:
            cache.clear()
        out = {"doc_id": ids, "ids": [tokens[a:b] for a, b in zip(token_at, token_at[1:], strict=False)]}
        if not offsets:
            return out
        return out | {
            "piece_start": [rel[a:b].astype(np.int32) for a, b in zip(piece_at, piece_at[1:], strict=False)],
            "piece_tokens": [counts[a:b].astype(np.int32) for a, b in zip(piece_at, piece_at[1:], strict=False)],
        }

    return encode


def encode(docs: DataFrame, ranks_path: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and with offsets also piece_start (code points) and piece_tokens (ids in each piece).

    Ids are those that the public library for such rank files gives without special tokens. ranks_path must be readable
    on every executor. A null or empty text gives empty arrays; repeated rows are encoded each; other columns are left.
    """
    return per_text(docs, lambda: _encoder(ranks_path, offsets), "doc_id long, ids array<int>" + ", piece_start array<int>, piece_tokens array<int>" * offsets)


@lru_cache(4)
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in order of id, and where each begins and how long it is."""
    ranks = read_ranks(path)
    token = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        token[v] = k
    size = np.array([len(t) for t in token], np.int64)
    return np.frombuffer(b"".join(token), np.uint8), np.cumsum(size) - size, size


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, decoded binary. A null list of ids decodes to no bytes; an id out of the file fails."""

    def run(batches):
        import pyarrow as pa

        blob, start, size = _token_table(ranks_path)
        for batch in batches:
            edges = np.asarray(batch.column(1).offsets).astype(np.int64)
            low = 0
            while low < len(batch):  # some 300,000 ids at a time
                high = max(low + 1, int(np.searchsorted(edges, edges[low] + 300_000)) - 1)
                part = batch.slice(low, high - low)
                ids = np.asarray(batch.column(1).values)[edges[low] : edges[high]]
                if len(ids) and (ids.min() < 0 or ids.max() >= len(size)):
                    raise ValueError("an id is not in the file of ranks")
                n = size[ids]
                ends = np.concatenate([[0], np.cumsum(n)])
                flat = blob[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])]
                at = ends[edges[low : high + 1] - edges[low]].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(at), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], names=["doc_id", "ids", "decoded"])
                low = high

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode_range(encoded: DataFrame, ranks_path: str, start: int, end: int) -> DataFrame:
    """doc_id, ids, decoded: of a text encoded with offsets, only the pieces that hold its code points start to end - 1.

    The offsets say which ids these are; the others are not decoded.
    """
    starts = F.concat("piece_start", F.array(F.lit(2**31 - 1)))
    which = F.filter(F.sequence(F.lit(0), F.size("piece_start")), lambda i: (i < F.size("piece_start")) & (F.get(starts, i) < end) & (F.get(starts, i + 1) > start))
    sum_ = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    first, many = F.coalesce(F.try_element_at(which, F.lit(1)), F.lit(0)), F.size(which)
    low = sum_(F.slice("piece_tokens", F.lit(1), first))
    return decode(encoded.select("doc_id", F.slice("ids", low + 1, sum_(F.slice("piece_tokens", first + 1, many))).alias("ids")), ranks_path)


@lru_cache(4)
def _digester(path: str) -> Callable[[list, list], dict]:
    """Encodes texts, decodes them piece by piece with the retained offsets, and hashes both."""
    from hashlib import sha256

    encode = _encoder(path)
    blob, start, size = _token_table(path)
    shown = [str(i) for i in range(len(size))]

    def f(doc_ids: list, texts: list) -> dict:
        out = encode(doc_ids, texts)
        ids_sha, decoded_sha = [], []
        for ids, piece_start, piece_tokens in zip(out["ids"], out["piece_start"], out["piece_tokens"], strict=True):
            ids_sha.append(sha256(",".join([shown[i] for i in ids.tolist()]).encode()).hexdigest())
            n = size[ids]
            ends = np.concatenate([[0], np.cumsum(n)])
            flat = blob[np.repeat(start[ids] - ends[:-1], n) + np.arange(ends[-1])]
            # code points before each piece: bytes that don't continue one
            points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
            if not np.array_equal(points[ends[np.cumsum(piece_tokens) - piece_tokens]], piece_start):
                raise ValueError("decoded pieces don't stand where their offsets say")
            decoded_sha.append(sha256(flat.tobytes()).hexdigest())
        return {
            "doc_id": doc_ids, "n_tokens": [len(x) for x in out["ids"]], "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "n_pieces": [len(x) for x in out["piece_start"]],
        }

    return f


def digest(docs: DataFrame, ranks_path: str) -> DataFrame:
    """One row a document: n_tokens, digests of its ids and of the bytes that they decode to, and n_pieces.

    Encoding and decoding are one pass: ids and offsets never leave the task. Decoded pieces must stand where their
    offsets say. The cases are those of ``encode``; empty tables give no rows.
    """
    return per_text(docs, lambda: _digester(ranks_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
