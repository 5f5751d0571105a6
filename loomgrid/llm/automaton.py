"""Regular expressions over bytes as one deterministic automaton.

A rule's expression is parsed into a nondeterministic automaton; the automata of all rules are
combined by subset construction (sets of states are integers) over byte classes, minimised by partition refinement and kept as
a transition array. Known: literals, escapes (also \\xNN), classes, groups, | ? * + {m} {m,} {m,n}.
"""

from __future__ import annotations

import numpy as np

ALL = (1 << 256) - 1  # sets of bytes are integers with a bit for each byte


def _bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


def _folded(mask: int) -> int:
    for c in range(97, 123):
        if mask >> c & 1 or mask >> (c - 32) & 1:
            mask |= 1 << c | 1 << (c - 32)
    return mask


class Parser:
    """Recursive descent to a tree of ("set", mask), ("cat", [..]), ("alt", [..]), ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def parse(self):
        tree = self.alternation()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.peek()!r} at {self.i} in {self.s!r}")
        return tree

    def alternation(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i : end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(least), (int(most) if most else None) if comma else int(least))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def atom(self):
        c = self.take()
        if c == "(":
            if self.s.startswith("?:", self.i):
                self.i += 2
            tree = self.alternation()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.s!r}")
            self.take()
            return tree
        if c == "[":
            return ("set", self.bracket())
        if c == ".":
            return ("set", ALL & ~(1 << 10))
        mask = 1 << (self.escaped() if c == "\\" else ord(c))
        return ("set", _folded(mask) if self.fold else mask)

    def bracket(self) -> int:
        negated, mask = self.peek() == "^", 0
        self.i += negated
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.s[self.i + 1 : self.i + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            mask |= _bits(range(low, high + 1))
        self.take()
        if self.fold:
            mask = _folded(mask)
        return ALL & ~mask if negated else mask


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Attach a tree to a state; the state after it."""
        kind = tree[0]
        if kind == "set":
            a, b = self.state(), self.state()
            self.empty[start].append(a)
            self.step[a] = (tree[1], b)
            return b
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for branch in tree[1]:
                self.empty[self.add(branch, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            out = self.state()
            self.empty[loop].append(out)
            return out
        ends = [start]
        for _ in range(most - least):
            start = self.add(part, start)
            ends.append(start)
        out = self.state()
        for e in ends:
            self.empty[e].append(out)
        return out

    def closure(self, state: int) -> int:
        """The states reachable without a byte, as bits."""
        seen, todo = 1 << state, [state]
        while todo:
            for t in self.empty[todo.pop()]:
                if not seen >> t & 1:
                    seen |= 1 << t
                    todo.append(t)
        return seen


def reversed_tree(tree):
    """The tree of the reversed expression."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind in ("cat", "alt"):
        return kind, [reversed_tree(t) for t in (tree[1][::-1] if kind == "cat" else tree[1])]
    return kind, reversed_tree(tree[1]), *tree[2:]


def _ones(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Automaton:
    """A minimal deterministic automaton: `classes` maps a byte to its class, `table` [state, class] is
    the next state, `accepts` has a bit for each rule that ends in a state, `alive` one for each rule that
    may still end. The start is state `start`."""

    def __init__(self, rules: list[tuple[str, bool]], search: bool, backward: bool = False):
        """rules: (expression, whether letters match in either case). search: a match may begin at any byte.
        backward: texts are read from their end, so a search tells where matches start."""
        nfa = Nfa()
        start, ends = nfa.state(), {}
        for k, (pattern, fold) in enumerate(rules):
            tree = Parser(pattern, fold).parse()
            ends[nfa.add(reversed_tree(tree) if backward else tree, start)] = 1 << k
        steps = [s for s in range(len(nfa.step)) if nfa.step[s]]
        parts = [ALL]
        for m in {nfa.step[s][0] for s in steps}:  # bytes that no expression tells apart
            parts = [y for x in parts for y in (x & m, x & ~m) if y]
        self.classes = np.zeros(256, np.uint8)
        for k, x in enumerate(parts):
            self.classes[list(_ones(x))] = k
        worth = sum(1 << s for s in {*steps, *ends})  # states that only pass on need not be kept
        after = {s: nfa.closure(nfa.step[s][1]) & worth for s in steps}
        by = [sum(1 << s for s in steps if nfa.step[s][0] & x) for x in parts]
        ending = sum(1 << s for s in ends)
        origin = nfa.closure(start) & worth
        seen, rows, accepts, todo = {origin: 0}, [], [], [origin]
        for now in todo:
            accepts.append(sum(ends[s] for s in _ones(now & ending)))
            row = []
            for mask in by:
                to = origin if search else 0
                for s in _ones(now & mask):
                    to |= after[s]
                if to not in seen:
                    seen[to] = len(todo)
                    todo.append(to)
                row.append(seen[to])
            rows.append(row)
        self.table, self.accepts, self.start = self._minimal(np.array(rows), np.array(accepts))
        self.alive = self.accepts.copy()
        while ((more := self.alive | np.bitwise_or.reduce(self.alive[self.table], axis=1)) != self.alive).any():
            self.alive = more

    @staticmethod
    def _minimal(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Refine the partition by what rules end, until all states of a part go to the same parts."""
        _, part = np.unique(accepts, return_inverse=True)
        while True:
            _, head, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_index=True, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == part.max():
                return part[table][head].astype(np.int32)[np.argsort(part[head])], accepts[head][np.argsort(part[head])], int(part[0])
            part = finer

    def shortest(self) -> int:
        """The least number of bytes after which a rule ends."""
        now, steps = {self.start}, 0
        while not any(self.accepts[s] for s in now):
            now = {int(t) for s in now for t in self.table[s]}
            steps += 1
        return steps
