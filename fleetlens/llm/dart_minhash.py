"""DartMinHash signatures of weighted sets, for many sets at once, in numpy.

An element of weight w owns a strip of width w and endless height. Darts lie in it as a
Poisson process that depends on the element alone. Each dart has a height (its rank) and
belongs to one coordinate of the signature; the coordinate's value is its earliest dart.
Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.

Strips are divided into cells of unit width and height. A set of total weight W throws the
darts of its cells below the height at which about k (ln k + 3) of them have fallen,
whatever W is; the few sets with a coordinate still empty go on to twice the height.
"""

from __future__ import annotations

import math

import numpy as np

from fleetlens.llm.words import mix

_U = np.uint64
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _uniform(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. size - 1 for each item in turn, and the item."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner


def signatures(cells: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """A line of ``k`` dart ids per set. Set i owns the unit-width cells ``cells[first[i]:first[i+1]]``;
    an element of weight w brings w cells with hashes of their own. Empty sets give zeros."""
    weight = np.diff(first)
    out = np.zeros((len(weight), k), dtype=np.uint64)
    todo = np.flatnonzero(weight > 0)
    height = k * (math.log(k) + 3) / np.maximum(weight, 1)
    while len(todo):
        inner, slot = _spread(weight[todo])
        cell = cells[first[todo][slot] + inner]
        layer, of = _spread(np.ceil(height[todo]).astype(np.int64)[slot])
        with np.errstate(over="ignore"):
            region = mix(cell[of] + mix(layer.astype(np.uint64)))
        count = np.searchsorted(_POISSON, _uniform(region))
        number, thrown = _spread(count)
        with np.errstate(over="ignore"):
            dart = mix(region[thrown] + mix(number.astype(np.uint64) + _U(1 << 32)))
        rank = layer[thrown] + _uniform(mix(dart ^ _U(0x5851F42D4C957F2D)))
        owner = slot[of[thrown]]
        below = rank < height[todo][owner]
        dart, rank, owner = dart[below], rank[below], owner[below]
        place = owner * k + (dart % _U(k)).astype(np.int64)
        # One sort key: the coordinate, then the rank in steps of a 2**31st of the height.
        order = np.argsort((place << 31) + (rank / height[todo][owner] * 2**31).astype(np.int64))
        place, dart = place[order], dart[order]
        earliest = np.diff(place, prepend=-1) > 0
        found = np.zeros((len(todo), k), dtype=np.uint64)
        found.reshape(-1)[place[earliest]] = dart[earliest]
        hit = np.zeros(len(todo) * k, dtype=bool)
        hit[place[earliest]] = True
        full = hit.reshape(len(todo), k).all(axis=1)
        out[todo[full]] = found[full]
        todo = todo[~full]
        height[todo] *= 2
    return out
