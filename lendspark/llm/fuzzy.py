"""Levenshtein automata intersected with a lexicon trie."""

from __future__ import annotations


def max_distance(term: str) -> int:
    """Edits that still count as the term: more for longer terms."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """Finds the lexicon term next to a word.

    A state of the product of the terms' Levenshtein automata and their trie
    is a set of (trie node, edits so far). States and their transitions are
    made when a word first needs them, so most words end in the dead state
    after a few look-ups. A stem accepts any word that begins with it.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach = [0]
        for term, into, most in [(w, self.end, max_distance(w)) for w in words] + [(s, self.stem, 0) for s in stems]:
            node = 0
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], most)
            into[node] = term
        self.alphabet = {c for kids in self.children for c in kids}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.ids: dict[tuple[tuple[int, int], ...], int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[list[str]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, with what missing letters reach added."""
        work = list(nodes)
        while work:
            n = work.pop()
            for kid in self.children[n].values():
                e = nodes[n] + 1
                if e <= self.reach[kid] and e < nodes.get(kid, 99):
                    nodes[kid] = e
                    work.append(kid)
        key = tuple(sorted((n, e) for n, e in nodes.items() if e <= self.reach[n]))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.found.append([self.stem[n] for n, e in key if e == 0 and self.stem[n]])
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in self.states[state]:
            reach(n, e + 1)
            for letter, kid in self.children[n].items():
                reach(kid, e if letter == c else e + 1)
        return self._state({n: e for n, e in nodes.items() if e <= self.reach[n]})

    def match(self, word: str) -> tuple[tuple[str, int] | None, list[str]]:
        """(term, edits) of the nearest term or None, and the stems that ``word`` begins with."""
        state, stems = self.start, []
        for c in word:
            c = c if c in self.alphabet else ""
            moves = self.moves[state]
            state = moves[c] if c in moves else moves.setdefault(c, self._move(state, c))
            stems += self.found[state]
            if not self.states[state]:
                break
        ends = [(e, self.end[n]) for n, e in self.states[state] if self.end[n] and e <= max_distance(self.end[n])]
        best = min(ends, default=None)
        return ((best[1], best[0]) if best else None), stems
