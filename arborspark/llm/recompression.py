"""Consistent symbols by recompression, for whole slices of documents at once.

A round first replaces every maximal run of one symbol by a symbol for (symbol,
length), then splits the symbols into left and right ones by a bit of their name
and replaces each adjacent pair (left, right) by a symbol for the pair.  A name is
a 64-bit hash of what it stands for, so naming is global without a dictionary:
equal runs and pairs get equal names in every document and task.

A symbol's existence depends on few neighbours.  The rounds carry this region of
dependence along; wherever the same words fill the region, the same symbol
stands.  Symbols at a document's edge depend on the edge and are certain nowhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shared import mix, pair_hash

#: Beyond every position.
FAR = np.int64(1) << np.int64(40)


@dataclass
class Level:
    """Symbols in order: name, words [start, stop), region of dependence [low, high), document."""

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray
    doc: np.ndarray

    def joined(self, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Level:
        """Neighbours from each first symbol up to the next one become one symbol."""
        at = np.flatnonzero(first)
        return Level(name, self.start[at], self.stop[np.append(at[1:], len(first)) - 1], low, high, self.doc[at])


def words_level(names: np.ndarray, of: np.ndarray) -> Level:
    at = np.arange(len(names))
    return Level(names, at, at + 1, at, at + 1, np.repeat(np.arange(len(of) - 1), np.diff(of)))


def _neighbours(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """low of the symbol before and high of the symbol after; at a document's edge, out of reach."""
    edge = level.doc[1:] != level.doc[:-1]
    before = np.concatenate([[-FAR], np.where(edge, -FAR, level.low[:-1])])
    after = np.concatenate([np.where(edge, FAR, level.high[1:]), [FAR]])
    return before, after


def block_round(level: Level) -> Level:
    """Every maximal run of one symbol becomes a symbol; it depends on both neighbours, which end the run."""
    first = np.ones(len(level.name), bool)
    first[1:] = (level.name[1:] != level.name[:-1]) | (level.doc[1:] != level.doc[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    times = (last - at + 1).astype(np.uint64)
    name = np.where(times > 1, pair_hash(level.name[at], times), level.name[at])
    before, after = _neighbours(level)
    low = np.minimum(np.minimum.reduceat(level.low, at), before[at])
    high = np.maximum(np.maximum.reduceat(level.high, at), after[last])
    return level.joined(first, name, low, high)


def pair_round(level: Level, turn: int) -> Level:
    """Every adjacent (left, right) becomes a symbol; a symbol left alone depends on the neighbour that it could have met."""
    right = (mix(level.name + np.uint64(turn)) >> np.uint64(63)).astype(bool)
    same = level.doc[1:] == level.doc[:-1]
    meets = np.zeros(len(right), bool)
    meets[:-1] = ~right[:-1] & right[1:] & same
    first = np.ones(len(right), bool)
    first[1:] = ~meets[:-1]
    before, after = _neighbours(level)
    alone = first & ~meets
    low = np.where(alone & right, np.minimum(level.low, before), level.low)
    high = np.where(alone & ~right, np.maximum(level.high, after), level.high)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(first)) - 1
    name = np.where(meets[at], pair_hash(level.name[at], level.name[last]), level.name[at])
    return level.joined(first, name, np.minimum(low[at], low[last]), np.maximum(high[at], high[last]))


def levels(names: np.ndarray, of: np.ndarray, rounds: int) -> list[Level]:
    """The symbols after each of the rounds, the words themselves first."""
    out = [words_level(names, of)]
    for turn in range(1, rounds + 1):
        out.append(pair_round(block_round(out[-1]), turn) if len(out[-1].name) else out[-1])
    return out
