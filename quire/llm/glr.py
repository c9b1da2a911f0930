"""Generalised LR tables and the least edits that make a sequence of symbols a sentence.

Parses run side by side on a graph-structured stack: a frontier holds the stacks that the symbols so
far can lead to, each once, with the least (cost, audit) of all ways there. Edits are moves of the
parse: Keep, Rerole and Insert shift a symbol, Delete leaves the stack. A stretch of symbols is summed up
by the moves from each stack to each, and stretches are put together like factors of a product, so a long
sequence can be parsed in parts."""

from __future__ import annotations

import heapq
from functools import lru_cache

END = "$"
Cost = tuple[int, str]


class Parser:
    """SLR tables of a grammar, {left: [right, ...]}, the first left the start; actions may be several.
    Left-recursive rules keep the number of stacks finite."""

    def __init__(self, grammar: dict[str, list[list[str]]]):
        start = next(iter(grammar))
        self.rules = [("", [start])] + [(left, right) for left, rights in grammar.items() for right in rights]
        self.grammar, self.states, self.actions = grammar, [], []
        follow = self._follow(start)
        number = {}
        todo = [self._closure({(0, 0)})]
        while todo:
            items = todo.pop()
            if items in number:
                continue
            number[items] = len(self.states)
            self.states.append(items)
            todo += [self._after(items, x) for x in {self._next(i) for i in items} - {None}]
        for items in self.states:
            act: dict[str, list[tuple[str, int]]] = {}
            for rule, dot in items:
                x = self._next((rule, dot))
                if x is not None:
                    move = ("shift", number[self._after(items, x)])
                    if move not in act.setdefault(x, []):
                        act[x].append(move)
                elif rule == 0:
                    act.setdefault(END, []).append(("accept", 0))
                else:
                    for x in follow[self.rules[rule][0]]:
                        act.setdefault(x, []).append(("reduce", rule))
            self.actions.append(act)
        self.symbols = sorted({x for _, right in self.rules for x in right if x not in grammar})
        self.first = (number[self._closure({(0, 0)})],)
        self.stacks = [self.first]  # all that can arise
        for stack in self.stacks:
            for x in self.symbols:
                self.stacks += [s for s in self.shifted(stack, x) if s not in self.stacks]
        self.number = {s: i for i, s in enumerate(self.stacks)}

    def _next(self, item):
        right = self.rules[item[0]][1]
        return right[item[1]] if item[1] < len(right) else None

    def _closure(self, items) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            x = self._next(todo.pop())
            for i, (left, _) in enumerate(self.rules):
                if left == x and x is not None and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def _after(self, items, x) -> frozenset:
        return self._closure({(r, d + 1) for r, d in items if self._next((r, d)) == x})

    def _follow(self, start: str) -> dict[str, set[str]]:
        empty, first = set(), {left: set() for left in self.grammar}
        follow = {left: set() for left in self.grammar}
        follow[start].add(END)
        sizes = None
        while sizes != (now := (len(empty), *map(len, first.values()), *map(len, follow.values()))):
            sizes = now
            for left, right in self.rules[1:]:
                if all(x in empty for x in right):
                    empty.add(left)
                for x in right:
                    first[left] |= first.get(x, {x})
                    if x not in empty:
                        break
                for i, x in enumerate(right):
                    if x in self.grammar:
                        for y in right[i + 1:]:
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[left]
        return follow

    @lru_cache(None)  # noqa: B019
    def _ready(self, stack: tuple[int, ...], ahead: str) -> tuple[set, bool]:
        """The stacks that a symbol can be shifted on, after all reductions before it."""
        seen, todo, accepted = set(), [stack], False
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            for what, n in self.actions[at[-1]].get(ahead, []):
                accepted |= what == "accept"
                if what == "reduce":
                    left, right = self.rules[n]
                    below = at[:len(at) - len(right)]
                    todo += [(*below, to) for kind, to in self.actions[below[-1]].get(left, []) if kind == "shift"]
        return seen, accepted

    @lru_cache(None)  # noqa: B019
    def shifted(self, stack: tuple[int, ...], symbol: str) -> list[tuple[int, ...]]:
        return sorted({(*at, n) for at in self._ready(stack, symbol)[0]
                       for what, n in self.actions[at[-1]].get(symbol, []) if what == "shift"})

    def accepts(self, stack: tuple[int, ...]) -> bool:
        return self._ready(stack, END)[1]


class Edits:
    """Frontiers of a parser under weighted edits; `given` are the symbols that Rerole and Insert can give."""

    def __init__(self, parser: Parser, given: str, delete: int, rerole: int, insert: int):
        self.parser, self.given = parser, given
        self.delete, self.rerole, self.insert = delete, rerole, insert

    @staticmethod
    def _offer(frontier: dict, stack: tuple, value: Cost) -> bool:
        """Equal stacks merge by the least (cost, audit). That is safe: of two audits for as many symbols at
        one cost none goes on the other, since inserts cost, so their order stays whatever follows."""
        if stack in frontier and frontier[stack] <= value:
            return False
        frontier[stack] = value
        return True

    def inserted(self, frontier: dict) -> dict:
        out = dict(frontier)
        queue = [(value, stack) for stack, value in out.items()]
        heapq.heapify(queue)
        while queue:
            value, stack = heapq.heappop(queue)
            if out[stack] == value:
                for x in self.given:
                    for to in self.parser.shifted(stack, x):
                        if self._offer(out, to, (value[0] + self.insert, value[1] + "I")):
                            heapq.heappush(queue, (out[to], to))
        return out

    def consumed(self, frontier: dict, symbol: str, extra: int, must_go: bool) -> dict:
        """The frontier after one more symbol, which costs `extra` where it stays."""
        out: dict = {}
        for stack, (cost, audit) in frontier.items():
            self._offer(out, stack, (cost + self.delete, audit + "D"))
            if not must_go:
                for to in self.parser.shifted(stack, symbol) if symbol in self.parser.symbols else ():
                    self._offer(out, to, (cost + extra, audit + "K"))
                for x in self.given:
                    for to in self.parser.shifted(stack, x):
                        self._offer(out, to, (cost + self.rerole + extra, audit + "R"))
        return out

    def moves(self, steps: list[tuple[str, int, bool]], starts: list[int]) -> dict[tuple[int, int], Cost]:
        """From each stack of `starts` to each that the steps (symbol, extra, must_go) lead to."""
        out = {}
        for start in starts:
            frontier = {self.parser.stacks[start]: (0, "")}
            for step in steps:
                frontier = self.consumed(self.inserted(frontier), *step)
            out |= {(start, self.parser.number[s]): v for s, v in frontier.items()}
        return out

    @staticmethod
    def product(a: dict, b: dict) -> dict[tuple[int, int], Cost]:
        out: dict = {}
        for (i, j), (cost, audit) in a.items():
            for (k, to), (more, rest) in b.items():
                if j == k and ((i, to) not in out or cost + more <= out[i, to][0]):
                    Edits._offer(out, (i, to), (cost + more, audit + rest))
        return out

    def best(self, moves: dict) -> Cost:
        frontier = {self.parser.stacks[to]: v for (start, to), v in moves.items() if start == 0}
        return min(v for s, v in self.inserted(frontier).items() if self.parser.accepts(s))
