"""Filling containers of fixed capacity by sum-of-squares packing.

Every text is an item of as many tokens as a public tokenizer counts. Items go to shards by a hash, each shard of about
``SHARD_ITEMS`` items, and every shard packs its items on its own, in an order given by the hash: an item is put where the sum of the
squared numbers of open containers per remaining gap becomes smallest, a new container being one of the choices. Ties go to the smallest
gap. Only identifiers and sizes are shuffled, never texts.

Sum of squares keeps containers open at all gaps for items to come. When a shard has seen its last item, none come any more: it
takes the items of its open containers out and lays them in once more, largest first, each into the fullest container that has room.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that a shard packs, on average; this bounds what one task holds.
SHARD_ITEMS = 25_000

#: Where the vocabularies of the public tokenizers lie unless a path is given.
TOKENIZERS = "/opt/tokenizers"

#: How text is cut into pieces before byte pairs are merged (fixed value, as published with the vocabularies).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str | None = None, pattern: str | None = None) -> Column:
    """Number of tokens of a text under a vocabulary file of byte pairs; 0 for null and empty texts."""
    path, pat = vocabulary or f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", pattern or PATTERN

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(path, pat).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts.to_numpy()], dtype="int32")

    return count(text)


def sum_of_squares(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container of each item in the order given, and the gap that each container is left with. Sizes lie between 1 and ``capacity``."""
    open_at = np.zeros(capacity + 1, dtype=np.int64)  # containers per gap; full and empty ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    placed, gaps = [], []
    never = np.int64(2**60)
    for s in sizes:
        # change of the sum for each gap g >= s: N[g] falls by one, N[g - s] rises by one
        here, left = open_at[s:capacity], open_at[: capacity - s]
        if len(here):
            change = 2 * (left - here) + 2
            change[0] = 1 - 2 * here[0]  # the container becomes full
            change[here == 0] = never
            k = int(change.argmin())
            best = int(change[k])
        else:
            k, best = 0, int(never)
        fresh = 2 * int(open_at[capacity - s]) + 1 if s < capacity else 0
        if best <= fresh and best < never:
            g = s + k
            c = stacks[g].pop()
            open_at[g] -= 1
        else:
            g, c = capacity, len(gaps)
            gaps.append(capacity)
        gaps[c] = g - s
        placed.append(c)
        if g - s:
            stacks[g - s].append(c)
            open_at[g - s] += 1
    return placed, gaps


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container numbers, from 0 without holes: sum of squares, then the items of containers left open once more, largest first into the best fit.

    Items of size 0 take no room and share the first container.
    """
    real = [i for i, s in enumerate(sizes) if s > 0]
    placed, gaps = sum_of_squares([sizes[i] for i in real], capacity)
    out = [0] * len(sizes)
    number: dict[int, int] = {}
    again = []
    for i, c in zip(real, placed, strict=True):
        if gaps[c]:
            again.append(i)
        else:
            out[i] = number.setdefault(c, len(number))
    count = len(number)
    room: list[tuple[int, int]] = []  # (gap, container), sorted
    for i in sorted(again, key=lambda i: -sizes[i]):
        s = sizes[i]
        k = bisect_left(room, (s, -1))
        if k < len(room):
            gap, c = room.pop(k)
        else:
            gap, c, count = capacity, count, count + 1
        out[i] = c
        if gap > s:
            insort(room, (gap - s, c))
    return out


def pack_items(items: DataFrame, item: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``item``, ``piece`` (from 1), ``n_tokens`` and ``container`` for every item or piece of one.

    An item above ``capacity`` is cut into full pieces and a rest; nothing else is cut. Null and negative sizes count as 0. Equal
    rows are items of their own. An empty table gives an empty result.
    """
    n = items.count()
    shards = max(1, -(-n // shard_items))
    s = F.greatest(F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)), F.lit(0))
    kind = dict(items.dtypes)[item]
    base = items.select(F.col(f"`{item}`").alias("item"), s.alias("s"))
    pieces = F.greatest(F.ceil(F.col("s") / capacity), F.lit(1)).cast("int")
    cut_up = base.select("item", "s", F.explode(F.sequence(F.lit(1), pieces)).alias("piece")).select("item", "piece", F.least(F.col("s") - (F.col("piece") - 1) * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))
    keyed = cut_up.withColumn("h", F.xxhash64("item", "piece")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "item", "piece"], kind="stable")
        local = pack(pdf["n_tokens"].tolist(), capacity)
        return pd.DataFrame({"item": pdf["item"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "container": np.asarray(local, dtype=np.int64) * shards + int(key[0])})

    return keyed.groupBy("shard").applyInPandas(run, f"item {kind}, piece int, n_tokens int, container bigint")
