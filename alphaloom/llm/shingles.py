"""Sets of word shingles as sorted 64-bit hashes, and their SetSketch registers. NumPy over whole batches of texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Bytes of text that are hashed at a time, give or take a word.
BLOCK = 1 << 18

_rng = np.random.default_rng(20240229)
_MASK = (1 << 64) - 1
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64, endpoint=False)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_PLACE = _rng.integers(1, 1 << 64, WORDS, np.uint64, endpoint=False) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 64, WORDS + 1, np.uint64, endpoint=False)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2^64, and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK)
        for name, x in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the result hangs on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of data, which ends with a space, that end with white space, and their places."""
    b = np.frombuffer(data, np.uint8)
    at, n = 0, len(b)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:
            ahead = end
            while ahead < n and not (found := np.flatnonzero(_SPACE[b[ahead : ahead + 65536]])).size:
                ahead += 65536
            end = min(n, ahead + int(found[0]) + 1) if ahead < n else n
        yield at, b[at:end]
        at = end


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word [^\\x20\\x09-\\x0D]+ of data (which ends with a space) begins, and its hash with A-Z as a-z."""
    begins, hashes = [], []
    for at, b in _blocks(data):
        space = _SPACE[b]
        first = ~space
        first[1:] &= space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        last = ~space
        last[:-1] &= space[1:]
        up, down = _power(len(b))
        sums = np.cumsum(_BYTE[b] * up, dtype=np.uint64)
        ends = sums[np.flatnonzero(last)]
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        begins.append(starts + at)
        hashes.append(mix((ends - before) * down[starts]))
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(begins), np.concatenate(hashes)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles: of WORDS words, or of the whole sequence where there are fewer; none without words."""
    lengths = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    begins, words = word_hashes(b" ".join([*texts, b""]))
    cuts = np.searchsorted(begins, np.concatenate(([0], np.cumsum(lengths))))
    n = len(words) - WORDS + 1
    full = np.zeros(0, np.uint64)
    if n > 0:
        total = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            total += words[k : k + n] * _PLACE[k]
        full = mix(total)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= WORDS:
            s = np.sort(full[a : b - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _SHORT[b - a]))
        else:
            out.append(full[:0])
    return out


def in_groups(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about so many bytes, and where they begin."""
    begin, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x) + 1
        if size >= most:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def digest(hashes: np.ndarray) -> bytes:
    """16 bytes that equal sets share."""
    a = int(hashes.sum(dtype=np.uint64)) if len(hashes) else 0
    b = int(np.bitwise_xor.reduce(mix(hashes + np.uint64(_STEP)))) if len(hashes) else 0
    return a.to_bytes(8, "big") + b.to_bytes(8, "big")


# --- SetSketch -----------------------------------------------------------------------------------------------------------------------------------------------

#: Registers; base and rate of their scale and their largest value.
REGISTERS = 120
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Probabilities with which a pair at the threshold may share no band, and may be estimated below the cut.
MISS, UNDER = 1e-6, 1e-9
_FACTOR = _rng.integers(1, 1 << 64, REGISTERS, np.uint64, endpoint=False) | np.uint64(1)
_SHIFT = _rng.integers(1, 1 << 64, REGISTERS, np.uint64, endpoint=False)
_ROW = _rng.integers(1, 1 << 64, REGISTERS, np.uint64, endpoint=False) | np.uint64(1)
_BAND = _rng.integers(1, 1 << 64, REGISTERS, np.uint64, endpoint=False)


def layout(percent: int) -> tuple[int, int]:
    """Rows and number of bands: the longest bands of which two sets at this similarity share none with a probability of at most MISS. 5 x 24 at 85, 4 x 30 at 80."""
    rows = [r for r in range(1, 31) if (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS]
    r = max(rows, default=1)
    return r, REGISTERS // r


def least_estimate(percent: int) -> float:
    """The estimate below which two sets at this similarity stay with a probability of at most UNDER: the share of registers that a binomial tail leaves out."""
    p, tail, k = percent / 100, 0.0, -1
    while k + 1 <= REGISTERS and tail + (more := math.comb(REGISTERS, k + 1) * p ** (k + 1) * (1 - p) ** (REGISTERS - k - 1)) <= UNDER:
        tail, k = tail + more, k + 1
    return max(k, 0) / REGISTERS


def registers(hashes: np.ndarray) -> np.ndarray:
    """floor(1 - log_BASE(x)) in [0, TOP] of the least x of each of REGISTERS exponential variates (rate RATE) per element. The maximum merges two sets' registers."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, _MASK, np.uint64)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def bands(sketch: np.ndarray, rows: int, number: int) -> np.ndarray:
    """A signed 64-bit key for each band of registers."""
    parts = sketch[: rows * number].reshape(number, rows).astype(np.uint64)
    return mix((parts * _ROW[:rows]).sum(axis=1, dtype=np.uint64) * np.uint64(_STEP) + _BAND[:number]).view(np.int64)


_GRID = np.linspace(0.0, 1.0, 201)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches (pairs x REGISTERS), given both sizes, from how many registers are greater, less and equal."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = size_a / (size_a + size_b)
    v = 1.0 - u
    j = _GRID[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    score = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], 1)[:, 0]
