"""Hashes of byte spans, of shingles and MinHash signatures, vectorised per text."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
# Odd multipliers: powers of an odd number can be inverted modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits, one to one."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Spans:
    """Polynomial hashes, modulo 2**64, of byte spans: a prefix sum over the text gives the
    hash of any span, and equal bytes hash alike wherever they stand."""

    def __init__(self, which: int = 0):
        self.base = _BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.byte = np.random.default_rng(97 + which).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        up, down = np.full(n + 1, self.base, np.uint64), np.full(n + 1, self.inverse, np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up), np.cumprod(down)

    def prefix(self, data: bytes) -> np.ndarray:
        n = len(data)
        if n >= len(self.up):
            self.grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[np.frombuffer(data, np.uint8)] * self.up[:n], out=sums[1:])
        return sums

    def hashes(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts])


# Odd multipliers of the two independent hashes of a sequence.
_TIMES = ((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03), (0xC2B2AE3D27D4EB4F, 0x8CB92BA72F3D8DD7))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(n, 2) independent 64-bit hashes of whole words."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2).astype(np.uint64)


def sequence_hashes(values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``n`` values, in order. Runs are put together from runs of half their
    length and mixed at every step, so no pattern of values makes runs collide."""
    first, second = map(_U, _TIMES[which])
    width, out = 1, values
    while 2 * width <= n:
        out = mixed(out[:-width] * first + out[width:])
        width *= 2
    if rest := n - width:
        out = mixed(out[:-rest] * second + out[rest:])
    return mixed(out ^ _U(n * _TIMES[which][1] & (1 << 64) - 1))


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; of the whole sequence if it has fewer words."""
    words = text.split()
    return sequence_hashes(word_hashes(words)[:, 0], min(n, len(words))) if words else np.zeros(0, np.uint64)


def joined_words(text: bytes) -> bytes:
    """The words, runs of bytes other than 0x20 and 0x09-0x0D, with one blank between them."""
    return b" ".join(text.split())


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a joined text."""
    if not joined:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(joined)]])


def word_ngrams(spans: Spans, joined: bytes, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; of the whole sequence if it has fewer words."""
    starts, ends = word_bounds(joined)
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = min(n, len(starts))
    return spans.hashes(spans.prefix(joined), starts[: len(starts) - n + 1], ends[n - 1 :])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    reach, out = 1, x
    while 2 * reach <= width:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class MinHash:
    """``size`` minima of a set of 64-bit hashes under multiply-and-xor permutations of 32 bits."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size = size
        self.times = rng.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, 1 << 32, size, dtype=np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """uint32 minima of one non-empty set; repeated members change nothing."""
        low = hashes.astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        step = max(1, 65_536 // max(1, len(low)))
        for part in np.array_split(low, -(-len(low) // 65_536)):
            for at in range(0, self.size, step):
                block = (part ^ self.flip[at : at + step, None]) * self.times[at : at + step, None]
                np.minimum(out[at : at + step], block.min(axis=1), out=out[at : at + step])
        return out

    def minima_of_runs(self, low: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(size, runs) minima of consecutive non-empty runs of 32-bit hashes."""
        out = np.empty((self.size, len(starts)), np.uint32)
        turned = np.empty_like(low)
        for j in range(self.size):
            np.bitwise_xor(low, self.flip[j], out=turned)
            np.multiply(turned, self.times[j], out=turned)
            np.minimum.reduceat(turned, starts, out=out[j])
        return out

    def minima_of_spans(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(size, spans) minima of non-empty spans of 32-bit hashes, in order and apart; ``low`` has a value behind the last."""
        cuts = np.column_stack([starts, ends]).ravel()
        out = np.empty((self.size, len(starts)), np.uint32)
        turned = np.empty_like(low)
        for j in range(self.size):
            np.bitwise_xor(low, self.flip[j], out=turned)
            np.multiply(turned, self.times[j], out=turned)
            out[j] = np.minimum.reduceat(turned, cuts)[::2]
        return out


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(..., bands) signed 64-bit keys: one hash for each band of ``rows`` minima and its number.
    ``minima`` has them along its last axis."""
    m = mixed(minima[..., : bands * rows].astype(np.uint64) + _U(1)).reshape(*minima.shape[:-1], bands, rows)
    odd = (np.arange(1, rows + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    keys = (m * odd).sum(axis=-1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
    return mixed(keys).view(np.int64)


def packed_bits(minima: np.ndarray, bits: int) -> np.ndarray:
    """(..., words) signed 64-bit words holding the low ``bits`` of each minimum, in lanes of
    that width; the last axis times ``bits`` must be a multiple of 64."""
    lanes = 64 // bits
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(*minima.shape[:-1], -1, lanes)
    shift = np.arange(lanes, dtype=np.uint64) * _U(bits)
    return np.bitwise_or.reduce(low << shift, axis=-1).view(np.int64)
