"""The seeded generator of samples and permutation tests, and hash splits.

Sequences must equal those of the store's other readers, so the two functions' constants are fixed values: 32-bit
FNV-1a over UTF-16 units for seeds, and mulberry32.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 0xFFFFFFFF
FNV_BASIS, FNV_PRIME = 0x811C9DC5, 0x01000193
STEP = 0x6D2B79F5
DEFAULT_SEED = "quern"
#: Swaps of an array's shuffle that are worked out at a time, and how many values are shuffled one by one.
SWAPS, FEW = 1 << 15, 2_000


def seed_of(text: str) -> int:
    h = FNV_BASIS
    units = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(units), 2):
        h = (h ^ (units[i] | units[i + 1] << 8)) * FNV_PRIME & WORD
    return h


class Mulberry:
    """State moves by a constant, so any position can be reached at once."""

    def __init__(self, seed: str | int = DEFAULT_SEED, skip: int = 0):
        start = seed_of(seed) if isinstance(seed, str) else seed
        self.state = (start + skip * STEP) & WORD

    def random(self) -> float:
        self.state = (self.state + STEP) & WORD
        t = self.state
        t = (t ^ t >> 15) * (t | 1) & WORD
        t ^= (t + ((t ^ t >> 7) * (t | 61) & WORD)) & WORD
        return (t ^ t >> 14) / 4294967296

    def below(self, n: int) -> int:
        return int(self.random() * n)

    def shuffle(self, values: list) -> None:
        """Fisher-Yates from the end."""
        for i in range(len(values) - 1, 0, -1):
            j = self.below(i + 1)
            values[i], values[j] = values[j], values[i]

    def draw(self, values: list, n: int) -> list:
        """``n`` of the values without putting back: the first places of a shuffle from the front."""
        pool = list(values)
        for i in range(min(n, len(pool))):
            j = i + self.below(len(pool) - i)
            pool[i], pool[j] = pool[j], pool[i]
        return pool[: min(n, len(pool))]

    def places(self, total: int, n: int) -> list[int]:
        """The places that ``draw`` takes from ``total`` values; only those that have moved are held."""
        moved: dict[int, int] = {}
        out = []
        for i in range(min(n, total)):
            j = i + self.below(total - i)
            out.append(moved.get(j, j))
            moved[j] = moved.pop(i, i)
        return out

    def take(self, n: int) -> np.ndarray:
        """The next ``n`` numbers at once."""
        t = np.arange(1, n + 1, dtype=np.uint32) * np.uint32(STEP) + np.uint32(self.state)
        self.state = (self.state + n * STEP) & WORD
        t = (t ^ t >> np.uint32(15)) * (t | np.uint32(1))
        t ^= t + (t ^ t >> np.uint32(7)) * (t | np.uint32(61))
        return (t ^ t >> np.uint32(14)) / 4294967296

    def shuffle_array(self, values: np.ndarray) -> None:
        """``shuffle`` of an array: the same swaps, made side by side as long as no two of them touch one place."""
        i = len(values) - 1
        while i > FEW:
            # so few swaps at once that hardly one batch in a hundred has two that meet
            wide = int(0.09 * i**0.5)
            deep = max(1, min(SWAPS, i - FEW) // wide)
            to = (self.take(deep * wide) * np.arange(i + 1, i + 1 - deep * wide, -1)).astype(np.intp).reshape(deep, wide)
            ordered = np.sort(to.astype(np.int32) if i < 1 << 31 else to, axis=1)
            first = i + 1 - wide * np.arange(1, deep + 1)
            meet = (ordered[:, -1] >= first) | (ordered[:, 1:] == ordered[:, :-1]).any(1)
            for low, met, places in zip(first.tolist(), meet.tolist(), to, strict=True):
                if met:
                    for k, j in enumerate(places.tolist()):
                        own = low + wide - 1 - k
                        values[own], values[j] = values[j], values[own]
                    continue
                own = values[low : low + wide][::-1]
                moved = values[places]
                values[places] = own
                own[:] = moved
            i -= deep * wide
        rest = values[: i + 1].tolist()
        self.shuffle(rest)
        values[: i + 1] = rest


def hash_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from SHA-256 of seed, NUL and key: the same on any engine."""
    digest = F.sha2(F.concat(F.lit(seed + "\0"), key), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296


def is_held_out(key: Column, fraction: float, seed: str = DEFAULT_SEED) -> Column:
    return hash_share(key, seed) < fraction


def arm_of(unit: Column, intervention: str, version: int, rate: float, seed: str = "holdout-arm") -> Column:
    """Which arm a unit is in for a version of an intervention."""
    share = hash_share(F.concat(unit, F.lit(f"\0{intervention}\0{version}")), seed)
    return F.when(share < rate, "held_out").otherwise("delivered")


def share_of(seed: str, key: str) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}\0{key}".encode()).digest()[:4], "big") / 4294967296
