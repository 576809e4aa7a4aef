"""The search within a model's bounds: the first place whose key is not below the probe. All strategies agree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(keys: np.ndarray, probe, start: int = 0) -> int:
    """Over all places, counting those below the probe."""
    return int(np.count_nonzero(keys < probe))


def binary(keys: np.ndarray, probe, start: int = 0) -> int:
    return int(np.searchsorted(keys, probe, side="left"))


def exponential(keys: np.ndarray, probe, start: int = 0) -> int:
    """From a guess outwards in doubling steps, then by halves."""
    n = len(keys)
    if not n:
        return 0
    at, step = min(max(start, 0), n - 1), 1
    if keys[at] < probe:
        lo = at
        while at < n and keys[at] < probe:
            lo, at, step = at + 1, at + step, step * 2
        hi = min(at, n)
    else:
        hi = at
        while at >= 0 and keys[at] >= probe:
            hi, at, step = at, at - step, step * 2
        lo = max(at + 1, 0)
    return lo + int(np.searchsorted(keys[lo:hi], probe, side="left"))


STRATEGIES = {"linear": linear, "binary": binary, "exponential": exponential}


def linear_all(keys: np.ndarray, probes: np.ndarray, start: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """linear() for many probes of one block."""
    return np.concatenate([np.count_nonzero(keys[None, :] < probes[a : a + at_once, None], axis=1) for a in range(0, len(probes), at_once)] or [np.empty(0, np.int64)])


def binary_all(keys: np.ndarray, probes: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.searchsorted(keys, probes, side="left")


def exponential_all(keys: np.ndarray, probes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """exponential() for many probes of one block: all double their steps together, then all halve what is left."""
    n = len(keys)
    if not n:
        return np.zeros(len(probes), np.int64)
    at = np.clip(start, 0, n - 1).astype(np.int64)
    lo, hi, step = np.zeros(len(probes), np.int64), np.full(len(probes), n, np.int64), 1
    up = keys[at] < probes
    lo[up], hi[~up] = at[up] + 1, at[~up]
    going = np.ones(len(probes), bool)
    while going.any():
        at = np.where(up, at + step, at - step)
        going &= (at >= 0) & (at < n)
        here = keys[np.clip(at, 0, n - 1)] < probes
        lo = np.where(going & here, np.maximum(lo, at + 1), lo)
        hi = np.where(going & ~here, np.minimum(hi, at), hi)
        going &= here == up  # the first step past the probe ends the run
        step *= 2
    while (lo < hi).any():
        mid = (lo + hi) // 2
        below = (keys[np.minimum(mid, n - 1)] < probes) & (lo < hi)
        lo, hi = np.where(below, mid + 1, lo), np.where(below | (lo >= hi), hi, mid)
    return lo


ALL = {"linear": linear_all, "binary": binary_all, "exponential": exponential_all}


def key_point(c: Column) -> Column:
    """A byte key as a number in the same order: its first seven bytes (shorter keys filled with zeros)."""
    return F.conv(F.substring(F.rpad(F.hex(c), 14, "0"), 1, 14), 16, 10).cast("long")


def unsigned(c: Column) -> Column:
    """A long as the unsigned number with the same bits."""
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)")).cast("decimal(20,0)")


def ordered_long(c: Column) -> Column:
    """An unsigned number below 2**64 (a decimal) as a long in the same order, for models and indexes."""
    return (c.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def from_ordered(c: Column) -> Column:
    """The unsigned number that ordered_long made c of."""
    return (c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(20,0)")
