"""Anchors: a place in every window, chosen by the window's content alone.

Equal windows have equal anchors, so windows need to be compared only under one
anchor's key.  Consecutive windows with the same anchor form a run; a run is
(key, first window, last window), and its span are the tokens of its windows.
"""

from __future__ import annotations

import numpy as np

from .recompression import FAR, levels
from .shared import mix, pair_hash, rolling, span_hash

WINDOW = 50


def window_starts(of: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of the width that starts at a token lies in one document."""
    valid = np.zeros(of[-1], bool)
    size = np.diff(of)
    some = size >= width
    edge = np.zeros(of[-1] + 1, np.int64)
    np.add.at(edge, of[:-1][some], 1)
    np.add.at(edge, (of[1:] - width + 1)[some], -1)
    np.cumsum(edge[:-1], out=edge[:-1])
    valid[:] = edge[:-1] > 0
    return valid


def _runs(valid: np.ndarray, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each run of valid windows with the same choice."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (choice[at[1:]] != choice[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1]


def least_within(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of values[i : i + width] for every i, by doubling; values beyond the end count as the greatest."""
    out = np.full(len(values) + width, np.iinfo(np.uint64).max, np.uint64)
    out[: len(values)] = values
    have = 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out[: len(values)]


def _covering(n: int, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every i < n the least value of the intervals [start, stop] that hold it; each is two overlapping powers of two long."""
    most = np.iinfo(np.uint64).max
    size = stop - start + 1
    power = np.frexp(size.astype(float))[1] - 1
    out = np.full(n, most, np.uint64)
    for k in range(int(power.max(initial=0)), -1, -1):
        if k < int(power.max(initial=0)):
            half = 1 << k
            upper = out.copy()
            out[half:] = np.minimum(out[half:], upper[: n - half])
        here = power == k
        np.minimum.at(out, start[here], value[here])
        np.minimum.at(out, stop[here] - (1 << k) + 1, value[here])
    return out


def word_runs(names: np.ndarray, of: np.ndarray, rounds: int = 4, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window of the runs over words, anchored at symbols of recompression.

    A window's anchor is its certain symbol of the highest level, then of the least
    hash, then the leftmost; where no level from ``least`` on has one, as within a
    long run of one word, the word of the least hash.  The key names the words on
    which the symbol depends; every window of the run holds them.
    """
    n = int(of[-1])
    valid = window_starts(of, WINDOW)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    low, high, rank, name = [], [], [], []
    for depth, level in enumerate(levels(names, of, rounds)):
        if depth >= least:
            fits = (level.high - level.low <= WINDOW) & (level.low > -FAR) & (level.high < FAR)
            low.append(level.low[fits])
            high.append(level.high[fits])
            name.append(level.name[fits])
            rank.append(np.full(int(fits.sum()), rounds - depth, np.uint64))
    low, high, rank, name = map(np.concatenate, (low, high, rank, name))
    order = np.argsort(rank << np.uint64(60) | mix(name) >> np.uint64(4), kind="stable")
    # equal symbols of one level tie, so the leftmost of them comes first: order is stable and positions rise within a level
    low, high = low[order], high[order]
    place = np.arange(len(low), dtype=np.uint64)
    choice = _covering(n, np.maximum(high - WINDOW, 0), low, place) if len(low) else np.full(n, np.iinfo(np.uint64).max, np.uint64)
    found = choice < len(low)
    bare = valid & ~found
    sums = rolling(names)
    keys, firsts, lasts = [], [], []
    first, last = _runs(valid & found, choice)
    of_run = choice[first].astype(np.int64)
    keys.append(span_hash(sums, low[of_run], high[of_run]) if len(first) else np.zeros(0, np.uint64))
    firsts.append(first)
    lasts.append(last)
    if bare.any():
        by_hash = mix(names) & ~np.uint64((1 << 30) - 1) | np.arange(n, dtype=np.uint64)
        word = least_within(by_hash, WINDOW) & np.uint64((1 << 30) - 1)
        first, last = _runs(bare, word)
        keys.append(mix(names[word[first].astype(np.int64)]))
        firsts.append(first)
        lasts.append(last)
    return np.concatenate(keys), np.concatenate(firsts), np.concatenate(lasts)


def doubled(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Prefix-doubling names of the 8, 16 and 32 bytes from every position; near the end they run into zeros.

    A name is the rank of a pair of ranks, the second at the offset of the first's
    length, with a 64-bit hash of the pair in the rank's place; of 8 bytes it is the bytes.
    """
    wide = np.zeros(len(raw) + 64, np.uint64)
    wide[: len(raw)] = raw
    for offset in (1, 2, 4):
        wide[:-offset] |= wide[offset:] << np.uint64(8 * offset)
    names = {8: wide}
    for size in (8, 16):  # 32 and the window's 50 = 32 + 18 follow in window_names
        x = names[size]
        names[2 * size] = pair_hash(x[:-size], x[size:])
    return names


def window_names(raw: np.ndarray) -> np.ndarray:
    """Names of the 50 bytes from every position: the pair of the 32-byte ranks there and 18 further on."""
    names = doubled(raw)[32]
    return pair_hash(names[:-18], names[18:])[: len(raw)]


#: Offsets in a window at which its byte anchor may begin: the KEY_BYTES from there on lie within the window.
KEY_BYTES = 25
OFFSETS = WINDOW - KEY_BYTES + 1


def byte_runs(raw: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last window of the runs over bytes.

    A window's anchor is the 8-byte name of the least hash among its first OFFSETS
    positions, the leftmost of equal ones; the key names the KEY_BYTES from there on
    by the 16-byte ranks at both of their ends.
    """
    valid = window_starts(of, WINDOW)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    names = doubled(raw)
    low = np.uint64((1 << 31) - 1)
    order = mix(names[8][: len(raw)]) & ~low | np.arange(len(raw), dtype=np.uint64)
    anchor = (least_within(order, OFFSETS) & low).astype(np.int64)
    first, last = _runs(valid, anchor)
    at = anchor[first]
    return pair_hash(names[16][at], names[16][at + KEY_BYTES - 16]), first, last
