"""Minimal perfect hash of a bounded set of 64-bit keys by hash and displace, with stored fingerprints."""

from __future__ import annotations

import numpy as np

#: Keys that share a displacement, on average.
PER_GROUP = 4
#: Displacements tried before the set gets another seed.
TRIES = 1 << 18


def mix64(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct keys onto 0 .. n - 1; other keys are told by their fingerprint (32 bits) with high chance."""

    def __init__(self, n: int, seed: int, shifts: np.ndarray):
        self.n, self.seed, self.shifts = n, seed, shifts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        groups = max(1, -(-n // PER_GROUP))
        for seed in range(64):
            group = (mix64(keys, 3 * seed) % np.uint64(groups)).astype(np.int64)
            one, two = mix64(keys, 3 * seed + 1), mix64(keys, 3 * seed + 2) | np.uint64(1)
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(groups + 1))
            taken = np.zeros(n, bool)
            shifts = np.zeros(groups, np.int32)
            sizes = np.diff(starts)
            done = True
            for g in np.argsort(-sizes, kind="stable"):
                if not sizes[g]:
                    break
                members = order[starts[g]:starts[g + 1]]
                if len(members) == 1:  # the rest get the free slots themselves
                    single = np.flatnonzero(sizes == 1)
                    shifts[single] = -1 - np.flatnonzero(~taken)
                    break
                a, b = one[members], two[members]
                for begin in range(0, TRIES, 256):
                    with np.errstate(over="ignore"):
                        tries = np.arange(begin, begin + 256, dtype=np.uint64)[:, None]
                        slots = ((a + tries * b) % np.uint64(n)).astype(np.int64)
                    fits = ~taken[slots].any(axis=1)
                    s = np.sort(slots, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                    if fits.any():
                        k = int(fits.argmax())
                        taken[slots[k]] = True
                        shifts[g] = begin + k
                        break
                else:
                    done = False
                    break
            if done:
                return cls(n, seed, shifts)
        raise ValueError("no perfect hash found; are the keys distinct?")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, in constant time."""
        if not self.n:
            return np.zeros(len(keys), np.int64)
        group = (mix64(keys, 3 * self.seed) % np.uint64(len(self.shifts))).astype(np.int64)
        with np.errstate(over="ignore"):
            shift = self.shifts[group].astype(np.int64)
            step = mix64(keys, 3 * self.seed + 2) | np.uint64(1)
            place = (mix64(keys, 3 * self.seed + 1) + shift.astype(np.uint64) * step) % np.uint64(self.n)
        return np.where(shift < 0, -1 - shift, place.astype(np.int64))

    @staticmethod
    def fingerprints(keys: np.ndarray) -> np.ndarray:
        return (mix64(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)
