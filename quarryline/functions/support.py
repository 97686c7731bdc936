"""Support thresholds of itemset mining."""

from __future__ import annotations


def min_count(min_support: float, n: int) -> int:
    """Frequent means more often than this: the product in double precision, cut to an integer."""
    return int(float(min_support) * n)


def at_least_fraction(count: int, n: int) -> float:
    """The fraction with which a miner that keeps ``support >= ceil(fraction * n)`` keeps what occurs more than ``count`` times."""
    return (count + 0.5) / n
