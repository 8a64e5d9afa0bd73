"""NumPy kernels over text buffers: span hashes, words, pre-tokens.  No Spark in here."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

U64 = np.uint64
# Fixed value: the pattern that cuts a text into pre-tokens, for the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MUL = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_INV = pow(_MUL, -1, 1 << 64)
_WINDOW = 1 << 18


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


@lru_cache(maxsize=4)
def _symbols(n: int) -> np.ndarray:
    """A fixed random 64-bit value for each symbol."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _WINDOW + 4096)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, m, U64))]) for m in (_MUL, _INV)]
    return _powers[0], _powers[1]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: int) -> np.ndarray:
    """64-bit hash of each symbols[start:end]; starts ascend.  Prefix sums of a polynomial with
    random coefficients, taken window by window so that memory doesn't follow the buffer."""
    out = np.empty(len(starts), U64)
    table = _symbols(alphabet)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + _WINDOW)))
        hi = int(ends[i:j].max())
        up, down = _power_tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        part = table[symbols[lo:hi]]
        part *= up[: hi - lo]
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(0xA24BAED4963EE407)
        i = j
    return mix64(out)


# Bytes 0x20 and 0x09-0x0D separate words; A-Z count as a-z.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the words of every row of a UTF-8 buffer."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SEPARATOR[data], out=inside[:-1])
    inside[-1] = False
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[:-1]
    cut = cut[cut < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    stops = inside[:-1].copy()
    stops[:-1] &= ~inside[1:-1]
    last = offsets[1:]
    last = last[last > 0] - 1
    stops[last] = inside[last]
    ends = np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word, words per row)."""
    starts, ends, per_row = word_spans(data, offsets)
    return span_hashes(_LOWER[data], starts, ends, 256), per_row


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle of width words, shingles per row).  A row with fewer words has
    its whole sequence as its one shingle; a row without words has none."""
    words, per_row = word_hashes(data, offsets)
    ends = np.cumsum(per_row)
    starts = ends - per_row
    n = len(words)
    full = np.maximum(per_row - width + 1, 0)
    short = (per_row > 0) & (per_row < width)
    acc = np.zeros(n, U64)
    for k in range(width):
        salted = mix64(words[k:] + U64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        acc[: n - k] += salted
    counts = full + short
    out = np.empty(int(counts.sum()), U64)
    at = np.cumsum(counts) - counts
    rows = np.flatnonzero(full)
    if len(rows):
        reps = full[rows]
        base = np.repeat(starts[rows] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        where = np.repeat(at[rows] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
        out[where] = mix64(acc[base])
    rows = np.flatnonzero(short)
    if len(rows):
        size = per_row[rows]
        h = size.astype(U64)
        for k in range(width - 1):
            more = size > k
            w = words[np.minimum(starts[rows] + k, n - 1)]
            h = np.where(more, mix64(h * U64(0xD6E8FEB86659FD93) + w), h)
        out[at[rows]] = h ^ U64(0x5851F42D4C957F2D)
    return out, counts


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = 1
        elif kind == "N":
            out[c] = 2
    space = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[space] = 3
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pretoken_starts(cp: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """Start of every pre-token in a buffer of code points that holds rows end to end.

    Equal to matching, row by row, the pattern: contraction, or letters, numbers or other signs
    with at most one blank before, or white space that leaves its last sign to what follows.
    row_starts: start of each row that isn't empty, ascending.
    """
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = char_classes()[cp]
    first = np.zeros(n + 1, bool)  # at n: a row would begin
    first[row_starts] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:-1]
    space = kind == 3
    # White space before a sign of its own row: its last sign stands alone, or joins what follows if a blank.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    start |= last
    joins = np.flatnonzero(last & (cp == 32)) + 1
    start[joins] = False
    # Contractions: an apostrophe that begins a pre-token, alone before letters.
    q = np.flatnonzero((cp == 39) & start)
    q = q[(q + 1 < n)]
    q = q[(kind[q + 1] == 1) & ~first[q + 1]]
    if len(q):
        a = cp[q + 1]
        b = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        q, length = q[hit], np.where(one, 2, 3)[hit]
        start[q + 1] = False
        after = q + length
        inside = after < n
        after = after[inside]
        # what is left of the letters begins a pre-token of its own; a blank that joins them can't stand here
        start[after[kind[after] == 1]] = True
    return np.flatnonzero(start)


def row_sets(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of every row."""
    ends = np.cumsum(counts)
    return [np.unique(values[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
