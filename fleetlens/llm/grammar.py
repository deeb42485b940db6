"""Re-Pair over many sequences at once, with numpy.

Re-Pair replaces the most frequent pair of adjacent symbols by a new symbol until no pair
repeats. Here a round replaces many pairs together: every occurrence whose pair is more
frequent than both pairs that overlap it (ties go by pair). Sequences lie in one array and
never share symbols, so a pair is counted inside its own sequence.

A symbol is described by its first occurrence, as positions in the array: where it begins,
where its right part begins, where it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Nodes:
    """Symbols ``begin``, ``middle``, ``end`` by first occurrence; ``place[first[i]:first[i + 1]]`` begin all of symbol i's."""

    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    first: np.ndarray
    place: np.ndarray


def _chosen(count: np.ndarray, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the pairs at positions ``at`` are replaced: no two that overlap."""
    if not len(at):
        return np.zeros(0, dtype=bool)
    touch = np.diff(at) == 1
    same = touch & (pair[1:] == pair[:-1])
    # Of equal pairs that overlap (a run of one symbol) every second one counts, from the left.
    head = np.concatenate([[True], ~same])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    odd = (np.arange(len(at)) - lead) % 2 == 1
    rises = touch & ~same & ((count[1:] > count[:-1]) | ((count[1:] == count[:-1]) & (pair[1:] > pair[:-1])))
    falls = touch & ~same & ~rises
    keep = ~odd
    keep[1:] &= ~falls
    keep[:-1] &= ~rises
    return keep


def repair(symbols: np.ndarray, sequence: np.ndarray, least: int = 2) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """The grammar's symbols round by round, and where the remaining ones begin, and their sequence.

    ``symbols`` of different sequences must differ; ``sequence`` ascends. A pair is replaced
    while it occurs ``least`` times or more.
    """
    n, rounds = len(symbols), []
    symbol, begin, owner = symbols.astype(np.int64), np.arange(n), sequence
    fresh = int(symbols.max(initial=-1)) + 1
    alive = np.concatenate([owner[1:] == owner[:-1], [False]]) if n else np.zeros(0, dtype=bool)
    while alive.any():
        at = np.flatnonzero(alive)
        # A pair as one number; symbols stay below twice the number of words.
        pair = symbol[at] * fresh + symbol[at + 1]
        _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
        count = times[inverse]
        often = count >= least
        alive[at[~often]] = False
        at, pair, count = at[often], pair[often], count[often]
        taken = _chosen(count, pair, at)
        if not taken.any():
            break
        left, made = at[taken], pair[taken]
        _, first, inverse = np.unique(made, return_index=True, return_inverse=True)
        ends = np.append(begin, n)
        # Sequences follow each other, so a symbol ends where the next one begins.
        order = np.argsort(inverse, kind="stable")
        rounds.append(
            Nodes(
                begin[left[first]],
                begin[left[first] + 1],
                ends[left[first] + 2],
                np.concatenate([[0], np.cumsum(np.bincount(inverse))]),
                begin[left][order],
            )
        )
        symbol[left] = fresh + inverse
        fresh += len(first)
        stays = np.ones(len(symbol), dtype=bool)
        stays[left + 1] = False
        new = np.zeros(len(symbol), dtype=bool)
        new[left] = True
        # Only pairs with a new symbol can be new; all others were counted before.
        symbol, begin, owner, alive, new = symbol[stays], begin[stays], owner[stays], alive[stays], new[stays]
        alive[new] = True
        alive[:-1] |= new[1:]
        alive &= np.append(owner[1:] == owner[:-1], False)
    return rounds, begin, owner


def bracket(begin: np.ndarray, owner: np.ndarray, n: int) -> list[Nodes]:
    """Pair the remaining symbols of each sequence side by side until one is left."""
    rounds = []
    while len(begin) > 1:
        inner = np.append(owner[1:] == owner[:-1], False)
        if not inner.any():
            break
        head = np.concatenate([[True], ~inner[:-1]])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(begin)), 0))
        left = np.flatnonzero(inner & ((np.arange(len(begin)) - lead) % 2 == 0))
        ends = np.append(begin, n)
        rounds.append(Nodes(begin[left], begin[left + 1], ends[left + 2], np.arange(len(left) + 1), begin[left]))
        stays = np.ones(len(begin), dtype=bool)
        stays[left + 1] = False
        begin, owner = begin[stays], owner[stays]
    return rounds
