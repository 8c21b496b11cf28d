"""Pigeonhole segment join for strings within ``k`` edits.

A string cut into ``k + 1`` segments keeps at least one of them whole under ``k`` edits, moved by no more than the edits before it.
``index_keys`` gives the segments of a string, ``probe_keys`` the substrings that could be such a segment of another one; two strings
within ``k`` edits share a key. A swap of neighbours counts as one edit, so probes are also taken with the letters at each border swapped.

``index_hashes`` and ``probe_hashes`` are the same as column expressions, for texts that meet only within one block; there a swap counts
as two edits, and of two texts the longer one probes (of two equally long ones both do).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1000)
def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the ``k + 1`` segments of a string, the shorter ones first."""
    n = k + 1
    base, extra = divmod(length, n)
    out, at = [], 0
    for i in range(n):
        size = base + (1 if i >= n - extra else 0)
        out.append((at, size))
        at += size
    return out


def index_keys(text: str, k: int) -> set[str]:
    """Keys of the segments; strings of at most ``k`` characters have only the key of their length."""
    if len(text) <= k:
        return {f"{len(text)}:"}
    return {f"{len(text)}:{i}:{text[p : p + n]}" for i, (p, n) in enumerate(cuts(len(text), k))}


def probe_keys(text: str, k: int) -> set[str]:
    """Keys under which any string within ``k`` edits of ``text`` has a segment in the index."""
    out = set()
    for length in range(max(0, len(text) - k), len(text) + k + 1):
        if length <= k:
            out.add(f"{length}:")
            continue
        moved = len(text) - length
        for i, (p, n) in enumerate(cuts(length, k)):
            lo, hi = max(0, p - i, p + moved - (k - i)), min(len(text) - n, p + i, p + moved + (k - i))
            for at in range(lo, hi + 1):
                out.add(f"{length}:{i}:{text[at : at + n]}")
        if length == len(text):
            for p, _ in cuts(length, k)[1:]:
                swapped = text[: p - 1] + text[p] + text[p - 1] + text[p + 1 :]
                out |= index_keys(swapped, k)
    return out


@lru_cache(maxsize=1000)
def probes(length: int, k: int) -> list[tuple[int, int, int, int]]:
    """Length and number of a segment, start and length of the substring that may be it, for all texts within ``k`` edits and not longer.

    A swap counts as two edits, as in ``probe_hashes``.
    """
    out = []
    for less in range(min(k, length) + 1):
        for i, (p, n) in enumerate(cuts(length - less, k)):
            # what stands before the segment has at most i edits, what stands after it at most k - i
            for shift in range(max(-i, less - (k - i)), min(i, less + k - i) + 1):
                if p + shift >= 0 and p + shift + n <= length:
                    out.append((length - less, i, p + shift, n))
    return out


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a text of ``length`` characters, as in ``cuts``."""
    base, extra = F.floor(length / (k + 1)).cast("int"), F.pmod(length, F.lit(k + 1))
    longer = F.greatest(F.lit(i) - (F.lit(k + 1) - extra), F.lit(0))
    return base * i + longer, base + F.when(F.lit(i) >= F.lit(k + 1) - extra, 1).otherwise(0)


def index_hashes(text: Column, k: int, block: Column) -> Column:
    """Hashes of the ``k + 1`` segments of a text within a block."""
    length = F.length(text)
    parts = [_segment(length, i, k) for i in range(k + 1)]
    return F.array(*[F.xxhash64(block, length, F.lit(i), F.substring(text, p + 1, n)) for i, (p, n) in enumerate(parts)])


def probe_hashes(text: Column, k: int, block: Column) -> Column:
    """Hashes under which any text of the block that is within ``k`` edits, and not longer, has a segment in the index."""
    length, out = F.length(text), []
    for less in range(k + 1):
        other = length - less
        for i in range(k + 1):
            p, n = _segment(other, i, k)
            # what stands before the segment has at most i edits, what stands after it at most k - i
            for shift in range(max(-i, less - (k - i)), min(i, less + k - i) + 1):
                fits = (other >= 0) & (p + shift >= 0) & (p + shift + n <= length)
                out.append(F.when(fits, F.xxhash64(block, other, F.lit(i), F.substring(text, p + shift + 1, n))))
    return F.array_distinct(F.filter(F.array(*out), lambda h: h.isNotNull()))
