"""Position models: small arrays that answer, for a key, between which positions its lower bound lies.

A model may be any guess with a bound on its error: whatever it is, the answer found within its bounds is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def ahead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b as unsigned numbers, 0 where a is below b: keys may be further apart than a long reaches."""
    a, b = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64))
    gap = np.ascontiguousarray(a).view(np.uint64) - np.ascontiguousarray(b).view(np.uint64)
    return np.where(a > b, gap, np.uint64(0))


def cone(keys: np.ndarray, pos: np.ndarray, error: float) -> list[tuple[int, float, int, int]]:
    """(first_key, slope, first_pos, n) of segments: lines through their first point that miss no point by more than error.

    A segment grows while the slopes allowed by its points have something in common; each try looks at a run of points
    at once, twice as long as the one before.
    """
    out, at, n = [], 0, len(keys)
    while at < n:
        lo, hi, end, run = 0.0, np.inf, at + 1, 64
        while end < n:
            x = ahead(keys[end : end + run], keys[at]).astype(np.float64)
            y = (pos[end : end + run] - pos[at]).astype(np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.maximum(np.maximum.accumulate(np.where(x > 0, (y - error) / x, np.where(y > error, np.inf, -np.inf))), lo)
                most = np.minimum(np.minimum.accumulate(np.where(x > 0, (y + error) / x, np.inf)), hi)
            bad = np.flatnonzero(least > most)
            if len(bad):
                if bad[0]:
                    lo, hi = least[bad[0] - 1], most[bad[0] - 1]
                end += int(bad[0])
                break
            lo, hi, end, run = least[-1], most[-1], end + len(x), run * 2
        slope = lo if not np.isfinite(hi) else (max(lo, 0.0) + hi) / 2
        out.append((int(keys[at]), float(max(slope, 0.0)), int(pos[at]), end - at))
        at = end
    return out


@dataclass
class Segments:
    """Lines over sorted keys (of every sample-th key if sample > 1); levels > 1 finds a line through upper lines."""

    first_key: np.ndarray
    slope: np.ndarray
    first_pos: np.ndarray
    error: int
    n: int
    sample: int = 1
    upper: Segments | None = None

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The segment of each key."""
        if self.upper is None:
            return np.maximum(np.searchsorted(self.first_key, keys, side="right") - 1, 0)
        lo, hi, _ = self.upper.bounds(keys)
        # within the upper level's bounds, the last segment that starts at or before the key
        lo, hi = np.maximum(lo - 1, 0), np.minimum(hi, len(self.first_key))
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            right = (self.first_key[np.minimum(mid, len(self.first_key) - 1)] <= keys) & (hi - lo > 1)
            lo, hi = np.where(right, mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
        return lo

    def bounds(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lower, upper (exclusive) and likeliest position of each key's lower bound; 0 <= lower < upper <= n + 1."""
        if not len(self.first_key):
            zero = np.zeros(len(keys), np.int64)
            return zero, zero + self.n + 1, zero
        s = self.place(keys)
        held = -(-(self.n + 1) // self.sample) if self.sample > 1 else self.n
        following = np.append(self.first_pos[1:], held)[s]
        # subtract before going to doubles: beyond 2**53 they'd lose the difference
        p = self.first_pos[s] + self.slope[s] * ahead(keys, self.first_key[s]).astype(np.float64)
        p = np.minimum(p, following)
        lower = np.floor(p - self.error - 1).astype(np.int64) * self.sample
        upper = (np.ceil(p + self.error + 2).astype(np.int64)) * self.sample
        past = s == len(self.first_key) - 1
        upper = np.where(past & (self.sample > 1) & (upper >= held * self.sample), self.n + 1, upper)
        approx = np.clip(np.rint(p).astype(np.int64) * self.sample, 0, self.n)
        return np.clip(lower, 0, self.n), np.clip(upper, 1, self.n + 1), approx


@dataclass
class Blocks:
    """The greatest key of every block of `size` rows."""

    max_key: np.ndarray
    size: int
    n: int

    def bounds(self, keys: np.ndarray):
        b = np.searchsorted(self.max_key, keys, side="left")
        lower = np.minimum(b * self.size, self.n)
        return lower, np.minimum(lower + self.size, self.n) + 1, lower


@dataclass
class Spline:
    """Points (key, position) joined by straight lines, found through a table of the keys' leading bits."""

    key: np.ndarray
    pos: np.ndarray
    shift: int
    radix: np.ndarray
    error: int
    n: int

    @classmethod
    def of(cls, key: np.ndarray, pos: np.ndarray, n: int, bits: int) -> Spline:
        span = int(key[-1]) - int(key[0]) if len(key) else 0
        shift = max(span.bit_length() - bits, 0)
        heads = (ahead(key, key[0]) >> np.uint64(shift)).astype(np.int64) if len(key) else key
        size = (int(heads[-1]) if len(key) else 0) + 2
        return cls(key, pos, shift, np.searchsorted(heads, np.arange(size + 1)), 0, n)

    def guess(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(keys))
        head = np.minimum(ahead(keys, self.key[0]) >> np.uint64(self.shift), np.uint64(len(self.radix) - 2)).astype(np.int64)
        lo, hi = np.maximum(self.radix[head] - 1, 0), np.minimum(self.radix[head + 1], len(self.key) - 1)
        while (hi - lo > 1).any():  # between the two knots of a prefix
            mid = (lo + hi) // 2
            right = (self.key[mid] <= keys) & (hi - lo > 1)
            lo, hi = np.where(right, mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
        lo = np.where(self.key[hi] <= keys, hi, lo)
        nxt = np.minimum(lo + 1, len(self.key) - 1)
        run = np.maximum(ahead(self.key[nxt], self.key[lo]), np.uint64(1)).astype(np.float64)
        step = np.clip(ahead(keys, self.key[lo]).astype(np.float64) / run, 0, 1)
        return self.pos[lo] + step * (self.pos[nxt] - self.pos[lo])

    def bounds(self, keys: np.ndarray):
        p = self.guess(keys)
        past = keys > self.key[-1] if len(self.key) else np.ones(len(keys), bool)
        p = np.where(past, self.n, p)
        return np.clip(np.floor(p - self.error - 1), 0, self.n).astype(np.int64), np.clip(np.ceil(p + self.error + 2), 1, self.n + 1).astype(np.int64), np.clip(np.rint(p), 0, self.n).astype(np.int64)


@dataclass
class TwoLevel:
    """A line over all keys chooses a leaf; each leaf has a line and its error."""

    least: int
    scale: float
    slope: np.ndarray
    intercept: np.ndarray
    first_pos: np.ndarray
    end_pos: np.ndarray
    error: np.ndarray
    n: int

    def leaf(self, keys: np.ndarray) -> np.ndarray:
        return np.clip((ahead(keys, self.least).astype(np.float64) * self.scale).astype(np.int64), 0, len(self.slope) - 1)

    def bounds(self, keys: np.ndarray):
        leaf = self.leaf(keys)
        p = self.intercept[leaf] + self.slope[leaf] * ahead(keys, self.least).astype(np.float64)
        p = np.clip(p, self.first_pos[leaf], self.end_pos[leaf])
        lower = np.maximum(np.floor(p - self.error[leaf] - 1), self.first_pos[leaf])
        upper = np.minimum(np.ceil(p + self.error[leaf] + 2), self.end_pos[leaf] + 1)
        return np.clip(lower, 0, self.n).astype(np.int64), np.clip(upper, 1, self.n + 1).astype(np.int64), np.rint(p).astype(np.int64)
