"""A deterministic automaton of several grammars at once, its states made when they are first met.

A grammar is a row of characters and classes with a count each: literal characters, [classes], \\s, \\d and \\w, then {n}, {n,}, {m,n},
+, * or ?, and at its end perhaps (?!class), what must not follow. A state is the set of places in all grammars at which
reading may stand, so reading a character costs one lookup, however many grammars there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

_PART = re.compile(r"(?P<not>\(\?!(?P<after>\[(?:\\.|[^\]\\])*\])\))|(?P<one>\[(?:\\.|[^\]\\])*\]|\\.|[^{}*+?()|])(?P<many>\{\d+(?:,\d*)?\}|[*+?])?")


def _parts(grammar: str) -> tuple[list[tuple[str, int, int | None]], str | None]:
    """([(class, least, most)], the class that must not follow)."""
    parts, after, at = [], None, 0
    while at < len(grammar):
        m = _PART.match(grammar, at)
        if not m or after:
            raise ValueError(f"{grammar!r} at {at}")
        at = m.end()
        if m["not"]:
            after = m["after"]
            continue
        many = m["many"] or "{1}"
        low, comma, high = many[1:-1].partition(",") if many[0] == "{" else {"*": ("0", ",", ""), "+": ("1", ",", ""), "?": ("0", ",", "1")}[many]
        parts.append((m["one"], int(low), (int(high) if high else None) if comma else int(low)))
    return parts, after


class Automaton:
    def __init__(self, grammars: Iterable[str]):
        #: of each place: what is read there, and where reading may stand after it
        self.reads: list[re.Pattern] = []
        self.then: list[set[int]] = []
        self.ends: dict[int, re.Pattern | None] = {}  # places at which a grammar ends, with what must not follow
        self.start: set[int] = set()
        for g in grammars:
            self._add(*_parts(g))
        self.sets: list[frozenset[int]] = [frozenset(self.start)]
        self.known = {self.sets[0]: 0}
        self.moves: list[dict[str, int]] = [{}]

    def _add(self, parts: list[tuple[str, int, int | None]], after: str | None) -> None:
        open_ends: list[set[int]] = [self.start]  # sets that are still to get the next places
        for one, low, high in parts:
            pattern = re.compile(one if len(one) > 1 else re.escape(one))
            for k in range(max(low, 1) if high is None else high):
                place = len(self.reads)
                self.reads.append(pattern)
                self.then.append(set())
                for s in open_ends:
                    s.add(place)
                # copies over the least may be left out, so what stands before them leads on, too
                open_ends = [self.then[place], *(open_ends if k >= low else [])]
            if high is None:
                self.then[place].add(place)
        last = len(self.reads)
        self.reads.append(re.compile(r"(?!)"))
        self.then.append(set())
        for s in open_ends:
            s.add(last)
        self.ends[last] = re.compile(after) if after else None

    def _move(self, state: int, c: str) -> int:
        to = frozenset(q for p in self.sets[state] if self.reads[p].fullmatch(c) for q in self.then[p])
        if to not in self.known:
            if len(self.sets) > 50_000:  # begin anew rather than grow without end
                self.sets, self.known, self.moves = self.sets[:1], {self.sets[0]: 0}, [{}]
                state = -1
            self.known[to] = len(self.sets)
            self.sets.append(to)
            self.moves.append({})
        if state >= 0:
            self.moves[state][c] = self.known[to]
        return self.known[to]

    def longest(self, text: str, at: int) -> int:
        """Where the longest match that begins at `at` ends; 0 without one."""
        state, found = 0, 0
        for i in range(at, len(text)):
            nxt = self.moves[state].get(text[i])
            state = self._move(state, text[i]) if nxt is None else nxt
            here = self.sets[state]
            if not here:
                break
            if not self.ends.keys().isdisjoint(here):
                after = text[i + 1 : i + 2]
                if any(q in self.ends and not (self.ends[q] and after and self.ends[q].fullmatch(after)) for q in here):
                    found = i + 1
        return found
