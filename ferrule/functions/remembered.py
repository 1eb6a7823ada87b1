"""Results that a task's Python keeps: what entries hold repeats from machine to machine of a fleet."""

from __future__ import annotations

import functools
from collections.abc import Callable

# What is kept for one function takes some 16 MB at most.
ENTRIES, LONGEST = 2048, 2048


def remembered(f: Callable) -> Callable:
    """f of texts, whose results for the latest ENTRIES different arguments are kept; long arguments are worked out each time.

    Callers must not change results.
    """
    kept = functools.lru_cache(ENTRIES)(f)

    @functools.wraps(f)
    def call(*texts):
        return kept(*texts) if sum(map(len, texts)) <= LONGEST else f(*texts)

    return call
