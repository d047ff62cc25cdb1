"""A suffix automaton over tokens, built online, with first end positions and matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """All substrings of the tokens added so far; state 0 is the empty one."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.first_end = [-1], [0], [-1]
        self.last = self.size = 0

    def add(self, token: Hashable) -> None:
        moves, link, length = self.next, self.link, self.length
        new, p = len(moves), self.last
        moves.append({})
        link.append(0)
        length.append(length[p] + 1)
        self.first_end.append(self.size)
        self.size += 1
        while p >= 0 and token not in moves[p]:
            moves[p][token] = new
            p = link[p]
        if p >= 0:
            q = moves[p][token]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                self.first_end.append(self.first_end[q])
                while p >= 0 and moves[p].get(token) == q:
                    moves[p][token] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def matches(self, tokens: Iterable[Hashable], least: int) -> Iterator[int]:
        """For each token: the first end position of the ``least`` tokens that end there, or -1.

        Walks the matching statistics: the longest substring that ends at each token.
        """
        moves, link, length = self.next, self.link, self.length
        at = size = 0
        for token in tokens:
            while at and token not in moves[at]:
                at = link[at]
                size = length[at]
            if token in moves[at]:
                at, size = moves[at][token], size + 1
            else:
                at = size = 0
            if size < least:
                yield -1
                continue
            while length[link[at]] >= least:  # the state whose substrings include the one of that length
                at = link[at]
                size = length[at]
            yield self.first_end[at]
