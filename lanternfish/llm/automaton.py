"""Minimal acyclic automata whose states number words, and completion of a word with exactly one error."""

from __future__ import annotations

from collections.abc import Iterable


class Automaton:
    """The minimal acyclic automaton of distinct words in code-point order (Daciuk et al., 2000). Each transition holds how
    many words come before those it leads to, so the sum along a word's path is its place in that order: a
    perfect hash. States are shared by equal rests, and no call recurses, so words may be of any length."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        known: dict[tuple, int] = {}
        edges: list[list[tuple[str, int]]] = [[]]
        ends, before = [False], ""
        for word in words:
            p, most = 0, min(len(word), len(before))
            while p < most and word[p] == before[p]:
                p += 1
            self._close(edges, ends, known, before, p)
            for _ in range(len(word) - p):
                edges.append([])
                ends.append(False)
            ends[-1], before = True, word
        self._close(edges, ends, known, before, 0)
        self.root = self._state(ends[0], edges[0], known)

    def _close(self, edges: list, ends: list, known: dict, word: str, depth: int) -> None:
        """The states of ``word`` below ``depth`` get no more transitions: each becomes the known state that is equal, or a new one."""
        while len(edges) > depth + 1:
            state = self._state(ends.pop(), edges.pop(), known)
            edges[-1].append((word[len(edges) - 1], state))

    def _state(self, final: bool, edges: list[tuple[str, int]], known: dict) -> int:
        key = (final, *edges)
        found = known.get(key)
        if found is None:
            place, out = int(final), {}
            for letter, state in edges:
                out[letter] = (state, place)
                place += self._size[state]
            found = known[key] = len(self.next)
            self.next.append(out)
            self.final.append(final)
            self._size.append(place)
        return found

    def _rest(self, state: int, place: int, word: str, at: int) -> int:
        """The number of the word that ends with ``word`` from ``at`` on, or -1."""
        for j in range(at, len(word)):
            step = self.next[state].get(word[j])
            if step is None:
                return -1
            state, place = step[0], place + step[1]
        return place if self.final[state] else -1

    def one_error(self, word: str, exact: int) -> list[int]:
        """Numbers of the words that begin as ``word`` does for ``exact`` letters, and differ from it by exactly one letter
        inserted, deleted or replaced after these. Each is found once: of places that give the same word the last is tried."""
        found, state, place, n = [], self.root, 0, len(word)
        for letter in word[:exact]:
            step = self.next[state].get(letter)
            if step is None:
                return found
            state, place = step[0], place + step[1]
        for i in range(exact, n + 1):
            letter = word[i] if i < n else ""
            for other, (to, before) in self.next[state].items():
                if other != letter:
                    found.append(self._rest(to, place + before, word, i))
                    if i < n:
                        found.append(self._rest(to, place + before, word, i + 1))
            if i < n:
                if i + 1 == n or word[i + 1] != letter:
                    found.append(self._rest(state, place, word, i + 1))
                step = self.next[state].get(letter)
                if step is None:
                    break
                state, place = step[0], place + step[1]
        return [x for x in found if x >= 0]
