"""Regular expressions of many rules as one minimal deterministic automaton over bytes, run over many lanes at once.

Matches are leftmost and longest. An automaton of the reversed rules, run from the end of a text, accepts where matches
begin; from there a rule's own automaton finds the end. Both only step through their transition arrays.

The subset of the syntax: literals, escapes, classes, groups, alternation, and the repeats ? * + {m} {m,} {m,n}.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


class _Parser:
    """A tree of tuples: ("set", bytes), ("cat", ...), ("alt", ...), ("rep", tree, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.s, self.k, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.k < len(self.s):
            raise ValueError(f"unread: {self.s[self.k :]}")
        return tree

    def peek(self) -> str:
        return self.s[self.k : self.k + 1]

    def take(self) -> str:
        self.k += 1
        return self.s[self.k - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", *parts)

    def repeated(self):
        tree = self.atom()
        while (c := self.peek()) and c in "?*+{":
            if c == "{":
                m = re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.s, self.k)
                self.k = m.end()
                least = int(m[1])
                tree = ("rep", tree, least, int(m[3]) if m[3] else None if m[2] else least)
            else:
                self.take()
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.k += 2
                return int(self.s[self.k - 2 : self.k], 16)
            return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))
        return ord(c)

    def cased(self, chars: set[int]) -> frozenset[int]:
        if self.any_case:
            chars |= {ord(f(chr(c))) for c in chars if chr(c).isalpha() for f in (str.lower, str.upper)}
        return frozenset(chars)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.take()
            if self.s.startswith("?:", self.k):
                self.k += 2
            tree = self.alternatives()
            self.take()
            return tree
        if c == "[":
            self.take()
            chars: set[int] = set()
            while self.peek() != "]":
                low = self.char()
                if self.peek() == "-" and self.s[self.k + 1 : self.k + 2] != "]":
                    self.take()
                    chars.update(range(low, self.char() + 1))
                else:
                    chars.add(low)
            self.take()
            return ("set", self.cased(chars))
        return ("set", self.cased({self.char()}))


@dataclass
class Rule:
    """A pattern. least: bytes that a match has at least behind the longest match of head at its beginning; one with
    fewer is dropped, but still takes its place."""

    name: str
    pattern: str
    any_case: bool = False
    head: str = ""
    least: int = 0

    def tree(self, pattern: str | None = None):
        return _Parser(self.pattern if pattern is None else pattern, self.any_case).parse()


@dataclass
class _Nfa:
    empty: list[list[int]] = field(default_factory=list)
    step: list[tuple[frozenset[int], int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.empty) - 1

    def build(self, tree, start: int) -> int:
        """Adds the tree after start; returns where it ends."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            here = self.state()
            self.empty[start].append(here)
            self.step[here] = (rest[0], end)
            return end
        if kind == "cat":
            for part in rest:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in rest:
                here = self.state()
                self.empty[start].append(here)
                self.empty[self.build(part, here)].append(end)
            return end
        part, least, most = rest
        for _ in range(least):
            start = self.build(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.build(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.empty[start].append(end)
            start = self.build(part, start)
        self.empty[start].append(end)
        return end


def backwards(tree):
    """The tree of the same texts, each from its end to its beginning."""
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", backwards(rest[0]), *rest[1:])
    return (kind, *map(backwards, rest[::-1] if kind == "cat" else rest))


#: Lanes that step together, least bytes of one, and bytes of which the states are held at once.
LANES, LEAST, SEGMENT = 16384, 256, 8 << 20
#: Lanes that step one by one instead, when so few are left.
FEW = 24


class Automaton:
    """A minimal deterministic automaton of some rules' trees, the k-th with bit 1 << k.

    classes: the class of each byte. next: the transition array, next[state * n_classes + class], states premultiplied
    by n_classes. accepts: the bits of each state; accepting states come last. If it searches, a match may begin at any
    byte, and a state accepts where one ends; else matches begin where a run does, and dead is the state of no return.
    """

    def __init__(self, trees: list[tuple], search: bool = True):
        nfa = _Nfa()
        start = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            here = nfa.state()
            nfa.empty[start].append(here)
            ends[nfa.build(tree, here)] = 1 << k
        sets = sorted({s[0] for s in nfa.step if s}, key=sorted)
        member = np.array([[b in s for s in sets] for b in range(256)])
        _, first, classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
        self.classes = classes.ravel().astype(np.int32)
        n = self.n_classes = len(first)
        closures: dict[int, frozenset[int]] = {}

        def closure(state: int) -> frozenset[int]:
            if state not in closures:
                seen, todo = {state}, [state]
                while todo:
                    for s in nfa.empty[todo.pop()]:
                        if s not in seen:
                            seen.add(s)
                            todo.append(s)
                closures[state] = frozenset(s for s in seen if nfa.step[s] or s in ends)
            return closures[state]

        # What each state of the rules leads to, by class, closed.
        moves = [[closure(step[1]) if step and int(b) in step[0] else frozenset() for b in first] for step in nfa.step]
        from_start = closure(start)
        number, order, table = {from_start: 0}, [from_start], []
        anew = from_start if search else frozenset()
        for states in order:  # subset construction
            row = []
            for c in range(n):
                to = anew.union(*[moves[s][c] for s in states])
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in order])
        table = np.array(table)
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:  # minimisation: split blocks by the blocks that their states lead to
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        some = np.unique(block, return_index=True)[1]
        place = np.lexsort((some, accepts[some] != 0))
        rank = np.empty_like(place)
        rank[place] = np.arange(len(place))
        small = rank[block[table[some[place]]]]
        self.accepts = accepts[some[place]].astype(np.int64)
        self.start = int(rank[block[0]]) * n
        self.first_accept = int(np.count_nonzero(self.accepts == 0)) * n
        self.next = (small * n).astype(np.int32).ravel()
        self.n_states = len(place)
        self.dead = int(rank[block[number[frozenset()]]]) * n if frozenset() in number else -1

    def positions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of bytes at which some rule's match ends, and the rules' bits; for one that searches.

        In time linear in the data, whatever it holds, and in memory for the states of one segment.
        """
        where, which, state = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], self.start
        for at in range(0, len(data), SEGMENT):
            states = self._states(self.classes[data[at : at + SEGMENT]], state)
            hit = np.flatnonzero(states >= self.first_accept)
            where.append(hit + at)
            which.append(self.accepts[states[hit] // self.n_classes])
            state = int(states[-1])
        return np.concatenate(where), np.concatenate(which)

    def _states(self, kinds: np.ndarray, state: int) -> np.ndarray:
        """The state after each byte, given the classes and the state before. The bytes are cut into lanes of one length,
        which step together, all but the first from the start; then those whose lane before ended otherwise go again
        until they meet the states that they had."""
        width = max(1, min(LANES, len(kinds) // LEAST))
        length = -(-len(kinds) // width)
        steps = np.zeros(width * length, np.int32)
        steps[: len(kinds)] = kinds
        steps = np.ascontiguousarray(steps.reshape(width, length).T)
        out = np.empty((length, width), np.int32)
        begun = np.full(width, self.start, np.int32)
        begun[0] = state
        now = begun.copy()
        for k in range(length):
            now = self.next[now + steps[k]]
            out[k] = now
        while True:
            true = np.concatenate([begun[:1], out[-1, :-1]])
            wrong = np.flatnonzero(true != begun)
            if len(wrong) <= FEW:
                break
            begun[wrong] = true[wrong]
            lanes, now = wrong, true[wrong]
            for k in range(length):
                now = self.next[now + steps[k, lanes]]
                other = now != out[k, lanes]
                if not other.all():
                    lanes, now = lanes[other], now[other]
                    if not len(lanes):
                        break
                out[k, lanes] = now
        for lane in wrong.tolist():  # one by one, on through the lanes behind
            now = int(out[-1, lane - 1])
            while lane < width and now != begun[lane]:
                begun[lane] = now
                column, before = steps[:, lane].tolist(), out[:, lane].tolist()
                for k, kind in enumerate(column):
                    now = int(self.next[now + kind])
                    if now == before[k]:
                        now = before[-1]
                        break
                    before[k] = now
                out[:, lane] = before
                lane += 1
        return out.T.ravel()[: len(kinds)]

    def longest(self, data: np.ndarray, at: int) -> int:
        """The end of the longest match that begins there, or -1; for one that does not search."""
        end, state, still = -1, self.start, 0
        while at < len(data):
            to = int(self.next[state + self.classes[data[at]]])
            if to == self.dead:
                break
            still = still + 1 if to == state else 0
            state, at = to, at + 1
            if still >= 64:  # a state that goes on: all bytes that keep it, at once
                kept = self.next[state + self.classes] == state
                ahead = kept[data[at : at + 16 * still]]
                n = len(ahead) if ahead.all() else int(np.argmin(ahead))
                at, still = at + n, still + n
            if state >= self.first_accept:
                end = at
        return end


class Scanner:
    """All leftmost, longest matches of each rule that do not overlap others of that rule. groups: rules that share an
    automaton; rules whose repeats count the same bytes need many states together."""

    def __init__(self, groups: list[list[Rule]]):
        self.rules = [rule for group in groups for rule in group]
        self.begins = [Automaton([backwards(rule.tree()) for rule in group]) for group in groups]
        self.whole = [Automaton([rule.tree()], search=False) for rule in self.rules]
        self.heads = [Automaton([rule.tree(rule.head)], search=False) if rule.head else None for rule in self.rules]
        for machine in self.begins:
            if (machine.next.reshape(-1, machine.n_classes)[:, machine.classes[10]] != machine.start).any():
                raise ValueError("a rule reads line feeds, which part texts")

    def find(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end) of its matches in bytes, in order; no rule may match over a line feed."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        first = 0
        for machine in self.begins:
            where, which = machine.positions(data[::-1])
            where, which = len(data) - 1 - where[::-1], which[::-1]
            rules = int(machine.accepts.max()).bit_length() if len(where) else 0
            for k in range(rules):
                self._rule(first + k, where[which >> k & 1 == 1], data, starts, out)
            first += int(np.bitwise_or.reduce(machine.accepts)).bit_length()
        for found in out:
            found.sort()
        return out

    def _rule(self, k: int, begins: np.ndarray, data: np.ndarray, starts: np.ndarray, out: list) -> None:
        rule, whole, head = self.rules[k], self.whole[k], self.heads[k]
        at = 0
        while at < len(begins):
            start = int(begins[at])
            end = whole.longest(data, start)
            inside = head.longest(data, start) if head else start
            if end - inside >= rule.least:
                of = int(np.searchsorted(starts, start, "right")) - 1
                out[of].append((start - int(starts[of]), k, end - int(starts[of])))
            at = int(np.searchsorted(begins, end, "left"))
