"""Merging shard Burrows-Wheeler transforms by interleave refinement, in memory.

This is the method named for suffix-array dedup, for shards that fit one process: each shard is sorted once, and the
merged order of two shards is found from their transforms alone. The interleave says, for each place of the merged order, which
shard its suffix comes from; one pass over both transforms turns the interleave by the first t symbols into
that by t + 1. Where two neighbours first fall apart gives their common prefix, so no suffix is compared or sorted again.

Its passes are as many as the symbols of a repeat and its tree of merges ends in one process, so the operator over
whole tables works on cuts instead (``suffix_dedup``, and the README has the figures). The tests hold both against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """A sorted collection of texts: the symbol before each suffix (0 before a text), and where the suffix starts.

    The first ``n_texts`` suffixes are the empty ones, in the order of the texts.
    """

    before: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    n_texts: int


def transform(texts: list[bytes], first: int = 0, depth: int = 400) -> Transform:
    """The transform of one shard, sorted by prefix doubling to ``depth`` symbols; ties keep their places."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate([np.frombuffer(t, np.uint8).astype(np.int32) + 1 if t else np.zeros(0, np.int32) for t in texts]) if len(texts) else np.zeros(0, np.int32)
    doc, n = np.repeat(np.arange(len(texts)), sizes), int(sizes.sum())
    starts = np.cumsum(sizes) - sizes
    at = np.arange(n) - np.repeat(starts, sizes)
    left = np.repeat(sizes, sizes) - at
    # ranks above the sentinels', which rank by text
    rank, k = data.astype(np.int64) + len(texts), 1
    while k < depth and n:
        ahead = np.where(left > k, rank[np.minimum(np.arange(n) + k, n - 1)], doc)
        order = np.lexsort((ahead, rank))
        new = np.ones(n, np.int64)
        new[1:] = (np.diff(rank[order]) != 0) | (np.diff(ahead[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) + len(texts)
        k *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(at > 0, data[np.maximum(np.arange(n) - 1, 0)], 0)
    last = np.where(sizes > 0, data[np.minimum(starts + sizes - 1, max(n - 1, 0))] if n else 0, 0)
    return Transform(np.concatenate([last, before[order]]).astype(np.uint16), np.concatenate([np.arange(len(texts)), doc[order]]) + first, np.concatenate([sizes, at[order]]), len(texts))


def merge(x: Transform, y: Transform, depth: int = 400) -> tuple[Transform, np.ndarray]:
    """The merged transform, and the common prefix of each suffix with the one before it, at most ``depth``."""
    n, texts = len(x.before) + len(y.before), x.n_texts + y.n_texts
    side = np.zeros(n, np.uint8)
    side[len(x.before) :] = 1
    common, apart = np.full(n, -1, np.int32), np.zeros(n, bool)
    apart[0] = True
    ends = np.r_[np.zeros(x.n_texts, np.uint8), np.ones(y.n_texts, np.uint8)]
    for t in range(1, depth + 1):
        # the t-symbol order: each side's symbols are taken up in the order so far, then stably sorted
        symbols = np.empty(n, np.uint16)
        symbols[side == 0], symbols[side == 1] = x.before, y.before
        place = np.argsort(symbols, kind="stable")[texts:]
        interval = np.cumsum(apart)[place]
        new = np.empty(n, np.uint8)
        new[:texts], new[texts:] = ends, side[place]
        parts = np.ones(n, bool)
        parts[texts + 1 :] = (np.diff(symbols[place]) != 0) | (np.diff(interval) != 0)
        common[parts & (common < 0)] = t - 1
        if parts.all() and (new == side).all():
            break
        side, apart = new, parts
    common[common < 0] = depth
    out = []
    for a, b in ((x.before, y.before), (x.doc, y.doc), (x.at, y.at)):
        both = np.empty(n, a.dtype)
        both[side == 0], both[side == 1] = a, b
        out.append(both)
    return Transform(*out, texts), common


def repeated_starts(texts: list[bytes], size: int, shards: int = 2) -> set[tuple[int, int]]:
    """(text, start) of all strings of ``size`` bytes that also start elsewhere."""
    cut = np.linspace(0, len(texts), max(shards, 2) + 1).astype(int)
    level = [transform(texts[a:b], int(a), size) for a, b in zip(cut, cut[1:], strict=False)]
    common = None
    while len(level) > 1:
        pairs = [merge(a, b, size) for a, b in zip(level[::2], level[1::2], strict=False)]
        level, common = [p[0] for p in pairs] + level[len(level) // 2 * 2 :], pairs[-1][1]
    near = np.r_[common >= size, False]
    hit = near[:-1] | near[1:]
    return set(zip(level[0].doc[hit].tolist(), level[0].at[hit].tolist(), strict=True))
