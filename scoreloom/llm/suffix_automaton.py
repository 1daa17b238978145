"""Suffix automaton of a sequence of words, with the two measures that operators need."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


class SuffixAutomaton:
    """The minimal automaton of all substrings of a sequence; built in linear time."""

    __slots__ = ("ends", "first", "length", "link", "moves")

    def __init__(self, seq: Sequence[Hashable]):
        moves: list[dict] = [{}]
        link, length, ends, first = [-1], [0], [], [-1]
        last = 0
        for x in seq:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            first.append(len(ends))
            p = last
            while p >= 0 and x not in moves[p]:
                moves[p][x] = new
                p = link[p]
            if p >= 0:
                q = moves[p][x]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    first.append(first[q])
                    while p >= 0 and moves[p].get(x) == q:
                        moves[p][x] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
            ends.append(new)
        #: The state of each prefix, and where the substrings of each state first end.
        self.moves, self.link, self.length, self.ends, self.first = moves, link, length, ends, first

    def repeats(self) -> list[int]:
        """For each position, the length of the longest substring ending there that occurs elsewhere too."""
        # A whole prefix occurs again if a longer substring's suffix link leads to it.
        again = set(self.link)
        return [self.length[v] if v in again else self.length[self.link[v]] for v in self.ends]

    def counts(self) -> list[int]:
        """How often the substrings of each state occur."""
        n = [0] * len(self.moves)
        for v in self.ends:
            n[v] = 1
        for v in sorted(range(1, len(n)), key=self.length.__getitem__, reverse=True):
            n[self.link[v]] += n[v]
        return n

    def walk(self, other: Sequence[Hashable]) -> Iterator[tuple[int, int]]:
        """For each position of another sequence, the length of the longest substring ending there that this one holds, and its state."""
        v, n = 0, 0
        moves, link, length = self.moves, self.link, self.length
        for x in other:
            while v and x not in moves[v]:
                v = link[v]
                n = length[v]
            if x in moves[v]:
                v = moves[v][x]
                n += 1
            yield n, v

    def matches(self, other: Sequence[Hashable]) -> list[int]:
        """The lengths of `walk`."""
        return [n for n, _ in self.walk(other)]


def covered(ending: Sequence[int], least: int) -> list[bool]:
    """Which positions lie in a run of at least `least` that ends at some position."""
    out = [False] * len(ending)
    reach = len(ending)
    for i in range(len(ending) - 1, -1, -1):
        if ending[i] >= least:
            reach = min(reach, i - ending[i] + 1)
        if i >= reach:
            out[i] = True
    return out
