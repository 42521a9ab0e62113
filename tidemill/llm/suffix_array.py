"""Suffix arrays over word numbers by prefix doubling, for many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray, depth: int | None = None, keep_ranks: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes of ids by their first `depth` numbers (None: entirely).

    Round r sorts by 2**r numbers, and only suffixes that are still tied take part in the next. With
    keep_ranks, also returns after each round the ranks, which are equal just for suffixes that share
    their first 2**r numbers."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), []
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ids[order[1:]] != ids[order[:-1]])))
    size = np.diff(np.concatenate((first, [n])))
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size, size) > 1]
    small = np.int32 if n < 1 << 31 else np.int64  # what is kept of a round
    kept, done = [rank.astype(small)] if keep_ranks else [], 1
    while tied.size and (depth is None or done < depth):
        after = tied + done
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        was = rank[tied]
        block = np.flatnonzero(np.concatenate(([True], was[1:] != was[:-1])))
        place = was + np.arange(len(tied)) - np.repeat(block, np.diff(np.concatenate((block, [len(tied)]))))
        order[place] = tied
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((new, [len(tied)])))
        rank[tied] = np.repeat(place[new], size)
        tied, done = tied[np.repeat(size, size) > 1], done * 2
        if keep_ranks:
            kept.append(rank.astype(small))
    return order, kept


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray], least: int) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the order; lengths under `least`
    come out as 0. ranks: those of suffix_array(keep_ranks=True)."""
    n = len(order)
    common = np.zeros(n, np.int64)
    if n < 2:
        return common
    floor = min(max(least, 1).bit_length() - 1, len(ranks) - 1)
    pair = np.flatnonzero(ranks[floor][order[1:]] == ranks[floor][order[:-1]]) + 1
    a, b, got = order[pair - 1].copy(), order[pair].copy(), np.zeros(len(pair), np.int64)
    for k in reversed(range(len(ranks))):
        again = np.ones(len(pair), bool)
        while again.any():  # more than once only at the highest rank
            inside = again & (a < n) & (b < n)
            again = np.zeros(len(pair), bool)
            again[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            step = again.astype(np.int64) << k
            a, b, got = a + step, b + step, got + step
            if k < len(ranks) - 1:
                break
    common[pair] = np.where(got >= least, got, 0)
    return common
