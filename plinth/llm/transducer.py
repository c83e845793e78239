"""Minimal acyclic transducer from words to sequences of ids, built from sorted words and read where it lies in a file.

Words that end alike share their last states. Ids stand on the transitions as
early as all words through them agree, so states behind a transition can be
shared whatever came before. States already complete are looked up by what
they accept and give, so the automaton is minimal at every step and its size
while building is that of the result plus one word.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class _State:
    __slots__ = ("final", "rest", "ways")

    def __init__(self):
        self.ways: dict[int, list] = {}  # byte -> [number of the next state, ids]
        self.final = False
        self.rest: tuple[int, ...] = ()  # ids given where a word ends here


def _agreed(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Builder:
    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._path = [_State()]
        self._last: bytes | None = None

    def _fixed(self, state: _State) -> int:
        """The number of a complete state; an equal one is used again."""
        key = (state.final, state.rest, tuple((b, to, out) for b, (to, out) in state.ways.items()))
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(key)
        return self.known[key]

    def _close(self, depth: int) -> None:
        """States of the last word beyond ``depth`` are complete."""
        while len(self._path) - 1 > depth:
            state = self._path.pop()
            self._path[-1].ways[self._last[len(self._path) - 1]][0] = self._fixed(state)

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        """Words come in strictly rising order."""
        if self._last is not None and word <= self._last:
            raise ValueError("words must rise")
        shared = _agreed(word, self._last or b"")
        self._close(shared)
        for depth in range(shared):
            way = self._path[depth].ways[word[depth]]
            n = _agreed(way[1], ids)
            if pushed := way[1][n:]:
                below = self._path[depth + 1]
                way[1] = way[1][:n]
                for onward in below.ways.values():
                    onward[1] = pushed + onward[1]
                if below.final:
                    below.rest = pushed + below.rest
            ids = ids[n:]
        for depth in range(shared, len(word)):
            self._path[-1].ways[word[depth]] = [-1, ids]
            ids = ()
            self._path.append(_State())
        self._path[-1].final, self._path[-1].rest = True, ids
        self._last = word

    def arrays(self) -> dict[str, np.ndarray]:
        """The finished automaton. The transition of state s by byte b lies in slot base[s] + b if that slot's ``owner`` is s; ids lie in ``pool``, each sequence after its length."""
        self._close(0)
        start = self._fixed(self._path[0])
        pool: dict[tuple[int, ...], int] = {(): -1}
        flat: list[int] = []

        def placed(ids: tuple[int, ...]) -> int:
            if ids not in pool:
                pool[ids] = len(flat)
                flat.extend((len(ids), *ids))
            return pool[ids]

        base = _bases([[byte for byte, _, _ in ways] for _, _, ways in self.states])
        slots = max(base, default=0) + 256
        owner, to, out = (np.full(slots, -1, np.int32) for _ in range(3))
        ends = np.full(len(self.states), -2, np.int32)  # no word ends here
        for s, (final, rest, ways) in enumerate(self.states):
            for byte, target, ids in ways:
                owner[base[s] + byte], to[base[s] + byte], out[base[s] + byte] = s, target, placed(ids)
            if final:
                ends[s] = placed(rest)
        return {"start": np.array([start], np.int32), "base": np.array(base, np.int32), "owner": owner, "to": to, "out": out, "ends": ends, "pool": np.array(flat, np.int32)}


def _bases(bytes_of: list[list[int]]) -> list[int]:
    """For each state the first base at which the slots of all its bytes are free, states of many bytes first."""
    free = np.ones(1 << 12, bool)
    base, low = [0] * len(bytes_of), 0
    for s in sorted(range(len(bytes_of)), key=lambda s: -len(bytes_of[s])):
        if not (own := bytes_of[s]):
            continue
        while True:
            spots = np.flatnonzero(free[low : low + 4096]) + low
            if low + 4096 + 512 > len(free):
                free = np.r_[free, np.ones(len(free), bool)]
                continue
            fits = spots[spots >= own[0]] - own[0]
            for byte in own[1:]:
                fits = fits[free[fits + byte]]
            if len(fits):
                break
            low += 4096
        base[s] = int(fits[0])
        free[base[s] + np.array(own)] = False
        if s and len(own) == 1 and len(spots) < 64:  # hardly any left here
            low += 4096 - 256 if low else 2048
    return base


def built(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    builder = Builder()
    for word, ids in words:
        builder.add(word, ids)
    return builder.arrays()


class Reader:
    """Looks words up in the arrays of :class:`Builder`, as they lie in a mapped file."""

    def __init__(self, data, places: dict[str, tuple[int, int]]):
        """``data``: the mapped file; ``places``: (first byte, bytes) of each array."""
        view = memoryview(data)
        ints = lambda name: view[places[name][0] : sum(places[name])].cast("i")
        self._data, self._place = data, places["pool"][0]
        self._start = ints("start")[0]
        self._base, self._owner, self._to, self._out, self._ends, self._pool = (ints(x) for x in ("base", "owner", "to", "out", "ends", "pool"))

    def _ids(self, at: int) -> bytes:
        place = self._place + 4 * at + 4
        return self._data[place : place + 4 * self._pool[at]]

    def get(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers; None if it is not in the lexicon."""
        base, owner, to, out, state, found = self._base, self._owner, self._to, self._out, self._start, b""
        for byte in word:
            slot = base[state] + byte
            if owner[slot] != state:
                return None
            if (at := out[slot]) >= 0:
                found += self._ids(at)
            state = to[slot]
        at = self._ends[state]
        return None if at == -2 else found + self._ids(at) if at >= 0 else found
