"""A generalized suffix automaton, and the matching statistics of texts against it."""

from __future__ import annotations


class SuffixAutomaton:
    """The automaton of all substrings of the texts added to it; state 0 is the empty one."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def add(self, text: str) -> None:
        length, link, nxt = self.length, self.link, self.next
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                nxt.append({})
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            else:
                last = self._split(last, q, c)

    def _split(self, p: int, q: int, c: str) -> int:
        """A copy of ``q`` for the shorter substrings that end by ``c`` after ``p``."""
        length, link, nxt = self.length, self.link, self.next
        copy = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(dict(nxt[q]))
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def windows(self, text: str, span: int) -> list[int]:
        """For each position of ``text`` the state of the last ``span`` characters, or -1 where their matching
        statistic (the longest suffix that the automaton knows) is shorter.

        The state is the one whose shortest substring is no longer than ``span``, so two positions have the same
        state if and only if the same ``span`` characters end there.
        """
        length, link, nxt = self.length, self.link, self.next
        state = known = 0
        found = []
        for c in text:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                known = length[state]
                to = nxt[state].get(c)
            if to is None:
                found.append(-1)
                continue
            state = to
            known += 1
            if known >= span:
                while length[link[state]] >= span:
                    state = link[state]
                known = span
                found.append(state)
            else:
                found.append(-1)
        return found
