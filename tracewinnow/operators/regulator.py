"""The memory regulator: how many traces a cache may hold, given the heap in use."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ratios of heap to target at which the mode changes, and the growth below them.  Fixed values.
EMERGENCY, HIGH, MODERATE, GROW, FACTOR = 1.3, 1.15, 1.0, 0.85, 1.02


def next_size(size: int, heap: int, target: int, least: int, most: int) -> int:
    ratio = heap / target
    if ratio > EMERGENCY:
        new = least
    elif ratio > HIGH:
        scale = target / heap
        new = int(size * scale * scale)
    elif ratio > MODERATE:
        new = int(size * float(target) / heap)
    elif ratio < GROW:
        new = int(size * FACTOR)
    else:
        new = size
    return max(least, min(most, new))


def next_size_column(size: Column, heap: Column, target: int, least: int, most: int) -> Column:
    """:func:`next_size` over columns."""
    size, heap = size.cast("double"), heap.cast("double")
    ratio, scale = heap / F.lit(float(target)), F.lit(float(target)) / heap
    new = F.when(ratio > EMERGENCY, F.lit(float(least))).when(ratio > HIGH, size * scale * scale).when(ratio > MODERATE, size * F.lit(float(target)) / heap).when(ratio < GROW, size * FACTOR).otherwise(size)
    return F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), F.floor(new).cast("long")))


@dataclass
class Regulator:
    """Resizes a cache (anything with ``size`` and ``resize``) towards a heap target."""

    least: int
    most: int
    target: int
    heap: Callable[[], int]
    cache: object

    def __post_init__(self):
        if self.least < 0 or self.most <= 0 or self.target <= 0:
            raise ValueError("sizes and target must be positive")
        if self.most <= self.least:
            raise ValueError("the largest size must exceed the least")
        if self.heap is None or self.cache is None:
            raise ValueError("a heap reading and a cache are needed")

    def step(self) -> int:
        new = next_size(self.cache.size, self.heap(), self.target, self.least, self.most)
        if new != self.cache.size:
            self.cache.resize(new)
        return new
