"""The random draws of Spark's tree fits, many at a time in NumPy.

A fit in tasks of its own (``growing.py``) takes the same rows and the same features as Spark's fit, because it draws from the
same generators with the same seeds: a shift-register generator for the rows and features, Java's generator for the seeds of nodes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MASK48, _MASK64 = 2**48 - 1, 2**64 - 1
_U, _W = np.uint64, np.uint32
#: Draws that one lane of a vector makes in a row.
_LANE = 64


def _murmur(words: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """MurmurHash3 of 32-bit words, as Scala computes it over their bytes; each word is an array with one entry per hash."""
    h = seed.astype(np.uint32)
    for k in words:
        k = k * _W(0xCC9E2D51)
        h = h ^ (k << _W(15) | k >> _W(17)) * _W(0x1B873593)
        h = (h << _W(13) | h >> _W(19)) * _W(5) + _W(0xE6546B64)
    h = h ^ _W(4 * len(words))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> _W(shift)) * _W(factor)
    return h ^ h >> _W(16)


def states_of(seeds: list[int]) -> np.ndarray:
    """The states that seeds are hashed to."""
    raw = np.array([seed & _MASK64 for seed in seeds], np.uint64)
    words = [(raw >> _U(32)).astype(np.uint32).byteswap(), (raw & _U(2**32 - 1)).astype(np.uint32).byteswap()]
    low = _murmur(words, np.full(len(raw), 0x3C074A61, np.uint32))
    return _murmur(words, low).astype(np.uint64) << _U(32) | low.astype(np.uint64)


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ s << _U(21)
    s ^= s >> _U(35)
    return s ^ s << _U(4)


def _mapped(images: np.ndarray) -> np.ndarray:
    """Lookup tables, one for each byte of a state, of the linear map that sends bit i to ``images[i]``."""
    tables = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for bit in range(8):
            half = 1 << bit
            tables[byte, half:2 * half] = tables[byte, :half] ^ images[8 * byte + bit]
    return tables


def _applied(tables: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros_like(s)
    for byte in range(8):
        out ^= tables[byte][(s >> _U(8 * byte) & _U(255)).astype(np.intp)]
    return out


@lru_cache(maxsize=64)
def _jump(power: int) -> np.ndarray:
    """The map that moves a state on by 2 * _LANE * 2**power steps."""
    if power:
        half = _jump(power - 1)
        return _mapped(_applied(half, _applied(half, _U(1) << np.arange(64, dtype=np.uint64))))
    images = _U(1) << np.arange(64, dtype=np.uint64)
    for _ in range(2 * _LANE):
        images = _step(images)
    return _mapped(images)


def uniforms(seed: int, count: int) -> np.ndarray:
    """The first ``count`` doubles of the generator with this seed; all lanes move at once."""
    if count == 0:
        return np.empty(0)
    lanes = -(-count // _LANE)
    states = states_of([seed])
    power = 0
    while len(states) < lanes:
        states = np.concatenate([states, _applied(_jump(power), states)])
        power += 1
    s, out = states[:lanes], np.empty((lanes, _LANE))
    for place in range(_LANE):
        s = _step(s)
        high = s & _U(2**26 - 1)
        s = _step(s)
        out[:, place] = (high << _U(27)) + (s & _U(2**27 - 1))
    return out.reshape(-1)[:count] * 2.0**-53


class NodeSeeds:
    """Java's linear generator, of which every node of a fit takes one long."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & _MASK48

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & _MASK48
        bits = self.state >> 16
        return bits - 2**32 if bits >= 2**31 else bits

    def next(self) -> int:
        high = self._next()
        return ((high << 32) + self._next() + 2**63) % 2**64 - 2**63


def chosen(seeds: list[int], total: int, wanted: int) -> np.ndarray:
    """``wanted`` of ``total`` features for each seed, drawn with a reservoir; one row per seed, in the order of the reservoir."""
    kept = np.tile(np.arange(min(wanted, total)), (len(seeds), 1))
    if wanted >= total or not seeds:
        return kept
    s = states_of(seeds)
    for place in range(wanted, total):
        s = _step(s)
        high = s & _U(2**26 - 1)
        s = _step(s)
        drawn = (((high << _U(27)) + (s & _U(2**27 - 1))) * 2.0**-53 * (place + 1)).astype(np.int64)
        hit = np.flatnonzero(drawn < wanted)
        kept[hit, drawn[hit]] = place
    return kept


def _improved(key: int) -> int:
    h = key + ~(key << 9) & 2**32 - 1
    h ^= h >> 14
    h = h + (h << 4) & 2**32 - 1
    return h ^ h >> 10


def map_order(keys: list[int], shift: int = 0) -> list[int]:
    """``keys`` as one of Scala's immutable maps, built from a mutable one, hands them out: Spark puts children of nodes on its stack in this order."""
    if len(keys) <= 4 and not shift:
        size = 16
        return sorted(keys, key=lambda k: (k & size - 1, k))
    by_bits: dict[int, list[int]] = {}
    for key in keys:
        by_bits.setdefault(_improved(key) >> shift & 31, []).append(key)
    alone = [by_bits[bits][0] for bits in sorted(by_bits) if len(by_bits[bits]) == 1]
    return alone + [key for bits in sorted(by_bits) if len(by_bits[bits]) > 1 for key in map_order(by_bits[bits], shift + 5)]
