"""Byte-pair encoding of whole texts by a public rank file.

Pre-tokenisation runs without a regex engine. All texts of an Arrow batch form
one array of code points; a table maps each code point to a class, bounded
look-ahead refines the class (an apostrophe that opens a contraction, the last
blank of a run), and each refined class is a transition function over the
states of a small automaton. The functions and all their products form a
finite monoid, numbered once, so composing two functions is one lookup in a
table and the state before each character comes from an associative scan by
doubling. Every product of a few functions is constant, so the scan stops after
as many doublings as it takes until all are (checked, not assumed). The slices
between the boundaries are looked up in a cache of merged pieces; their code
point offsets remain available for decoding.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

# Classes of characters, refined by look-ahead.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE1, QUOTE2, LAST_SPACE, BREAK = range(9)
# States: what the last character belongs to. TWO and ONE: inside a contraction with that many letters to come.
S_NONE, S_LETTER, S_NUMBER, S_OTHER, S_GLUE, S_SPACE, S_TWO, S_ONE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins at this character."""
    if state == S_TWO:
        return S_ONE, False
    if state == S_ONE:
        return S_NONE, False
    if kind == BREAK:
        return S_NONE, True
    glued = state == S_GLUE
    if kind == LETTER:
        return S_LETTER, not (glued or state == S_LETTER)
    if kind == NUMBER:
        return S_NUMBER, not (glued or state == S_NUMBER)
    if kind == OTHER or (kind in (QUOTE1, QUOTE2) and (glued or state == S_OTHER)):
        return S_OTHER, not (glued or state == S_OTHER)
    if kind == QUOTE1:
        return S_ONE, True
    if kind == QUOTE2:
        return S_TWO, True
    if kind == BLANK:  # a blank right before a non-space: opens the next piece
        return S_GLUE, True
    if kind == LAST_SPACE:  # the last of a run, no blank: a piece of its own
        return S_NONE, True
    return S_SPACE, state != S_SPACE


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number all products of the transition functions.

    Returns the product table [first, then], for each element its value at
    state NONE, whether it is constant, and the table of beginnings [state, class].
    """
    gens = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    ids: dict[tuple[int, ...], int] = {}
    for g in gens:
        ids.setdefault(g, len(ids))
    todo = list(ids)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    elements = list(ids)
    table = np.array([[ids[tuple(b[x] for x in a)] for b in elements] for a in elements], np.uint8 if len(elements) < 256 else np.uint16)
    start = np.array([f[S_NONE] for f in elements], np.uint8)
    constant = np.array([len(set(f)) == 1 for f in elements])
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    generator = np.array([ids[g] for g in gens], table.dtype)
    return table, start, constant, (begins, generator)


_TABLE, _START, _CONSTANT, (_BEGINS, _GENERATOR) = _monoid()
_PRODUCTS, _BEGINS_FLAT = _TABLE.ravel(), _BEGINS.ravel()


def _classes() -> np.ndarray:
    """Class of each code point, by the Unicode database of this Python."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    spaces = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[spaces] = SPACE
    return out


_CLASS: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        _CLASS = _classes()
    return _CLASS


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Offsets at which pieces begin in ``codes``; ``breaks`` are the offsets at which texts begin."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[codes]
    first = np.zeros(n + 1, bool)
    first[breaks] = True
    first[n] = True
    ends = first[1:]  # the last character of a text
    nxt = np.empty(n, np.uint8)
    nxt[:-1] = kind[1:]
    nxt[-1] = SPACE
    nxt[ends] = SPACE
    space = kind == SPACE
    # The last space of a run stands alone, unless the text ends with the run.
    last = space & (nxt != SPACE) & ~ends
    kind[last] = LAST_SPACE
    kind[last & (codes == 32)] = BLANK
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        padded = np.zeros(n + 2, codes.dtype)
        padded[:n] = codes
        stop = np.ones(n + 3, bool)
        stop[: n + 1] = first
        a, b = padded[quote + 1], padded[quote + 2]
        inside1 = ~stop[quote + 1]
        inside2 = inside1 & ~stop[quote + 2]
        one = inside1 & np.isin(a, np.array([ord(x) for x in "stmd"], codes.dtype))
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        kind[quote[one]] = QUOTE1
        kind[quote[two & inside2]] = QUOTE2
    # Scan: f[i] = the function of all characters from some point to i; doubling until all are constant.
    f = _GENERATOR[kind]
    # A text starts in state NONE whatever came before: its first function is made constant.
    starts = np.flatnonzero(first[:n])
    reset = {k: _constant_like(k) for k in range(9)}
    f[starts] = np.array([reset[k] for k in range(9)], f.dtype)[kind[starts]]
    step = 1
    while step < n:
        if step <= 2:  # almost all are open: compose the whole array
            f[step:] = _PRODUCTS[f[:-step].astype(np.int32) * len(_TABLE) + f[step:]]
        else:
            open_ = np.flatnonzero(~_CONSTANT[f[step:]]) + step
            if not len(open_):
                break
            f[open_] = _TABLE[f[open_ - step], f[open_]]
        step *= 2
    before = np.empty(n, np.uint8)
    before[0] = S_NONE
    before[1:] = _START[f[:-1]]
    before[starts] = S_NONE
    return np.flatnonzero(_BEGINS_FLAT[before * np.uint8(9) + kind] | first[:n])


def _constant_like(kind: int) -> int:
    """The monoid's constant function with the value that ``kind`` gives from NONE."""
    want = _step(S_NONE, kind)[0]
    for i in np.flatnonzero(_CONSTANT):
        if _START[i] == want:
            return int(i)
    raise AssertionError("each state is reached by a constant product")


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one piece: lowest rank first, leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= 40:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # Long pieces: a heap over a linked list, O(n log n).
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def push(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(piece[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != k:
            continue
        end[i] = k
        alive[j] = False
        if k < n:
            prev[k] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Index(dict):
    """Piece to number; a missing piece is merged and added."""

    def __init__(self, add):
        self.add = add

    def __missing__(self, piece: str) -> int:
        return self.add(piece)


class Encoder:
    """Encodes batches of texts; keeps a bounded cache of merged pieces."""

    def __init__(self, rank_file: str, cache: int = 400_000):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.limit = cache
        self._clear()

    def _clear(self) -> None:
        self.index = _Index(self._add)
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int32)

    def _add(self, piece: str) -> int:
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        k, n = len(self.index), len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k == len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.flat[self.used : self.used + n] = ids
        self.starts[k], self.counts[k] = self.used, n
        self.used += n
        self.index[piece] = k
        return k

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The joined text, the offset of each text, the offset of each piece."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        return joined, offsets, boundaries(codes, offsets[:-1][lengths > 0])

    def encode(self, texts: list[str], counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """Flat ids (or None) and the offsets of each text's ids in them."""
        if len(self.index) > self.limit:
            self._clear()
        joined, offsets, cuts = self.pieces(texts)
        index, bounds = self.index, cuts.tolist()
        bounds.append(len(joined))
        at = np.array([index[joined[a:b]] for a, b in zip(bounds, bounds[1:])], np.int64)
        n = self.counts[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        text_at = ends[np.searchsorted(cuts, offsets)]
        if counts_only:
            return None, text_at
        shift = np.repeat(self.starts[at] - ends[:-1], n)
        return self.flat[shift + np.arange(ends[-1])], text_at

    def starts_of(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each id the offset in UTF-8 bytes of its token in its text: slices of the text that decode to it."""
        if not hasattr(self, "_sizes"):
            self._sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for token, i in self.ranks.items():
                self._sizes[i] = len(token)
        size = self._sizes[flat]
        total = np.concatenate([[0], np.cumsum(size)])
        return (total[:-1] - np.repeat(total[ends[:-1]], np.diff(ends))).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_back"):
            self._back = {v: k for k, v in self.ranks.items()}
        return b"".join(self._back[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(rank_file: str) -> Encoder:
    """One encoder for each worker process and rank file."""
    if rank_file not in _ENCODERS:
        _ENCODERS[rank_file] = Encoder(rank_file)
    return _ENCODERS[rank_file]


def groups(texts: list[str], most: int = 150_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters together (a longer text alone)."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
