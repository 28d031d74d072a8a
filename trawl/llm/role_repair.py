"""Least-cost repair of role sequences: an LR automaton, a stack graph, and weighted edits.

A grammar over role initials becomes LR(0) item sets with SLR lookahead. Repair
keeps every stack that some edits of the rows so far lead to. A stack is a node
(state, node below), shared by all stacks that stand on it; equal stacks merge by
the least (cost, audit). Rows come in blocks: a block's table from start stack to
end stack can be made without the rows before it, so long conversations are cut.

Edits, with fixed costs: Keep 0, Rerole 3, Delete 4, Insert 3; a kept or reroled
truncated row costs 3 more. An audit is the edits' initials in order.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: (s?(ua)+)? as a left-recursive grammar; other keys are terminals.
ROLE_GRAMMAR = {"C": ["", "T", "sT"], "T": ["P", "TP"], "P": ["ua"]}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Roles that edits may make.
MADE = "ua"
_END = "$"

Weight = tuple[int, str]


class Automaton:
    """Shift and reduce moves of a grammar whose first key is its start symbol."""

    def __init__(self, grammar: dict[str, list[str]]) -> None:
        self.rules = [("^", next(iter(grammar)))] + [(left, right) for left, rights in grammar.items() for right in rights]
        self.grammar = grammar
        self.follow = self._follow()
        self.states = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        for number, items in enumerate(self.states):  # grows while it is read
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                ahead = self._closure({(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == symbol})
                if ahead not in self.states:
                    self.states.append(ahead)
                self.goto[number, symbol] = self.states.index(ahead)

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        found, todo = set(items), list(items)
        while todo:
            rule, at = todo.pop()
            wanted = self.rules[rule][1][at : at + 1]
            for r, (left, _) in enumerate(self.rules):
                if left == wanted and (r, 0) not in found:
                    found.add((r, 0)), todo.append((r, 0))
        return frozenset(found)

    def _follow(self) -> dict[str, set[str]]:
        first = {left: set() for left in self.grammar}
        follow = {left: set() for left in self.grammar} | {"^": {_END}}
        while True:
            before = sum(map(len, [*first.values(), *follow.values()]))
            for left, right in self.rules:
                tail = set(follow[left])  # what may come behind the symbol at hand
                for symbol in reversed(right):
                    if symbol in self.grammar:
                        follow[symbol] |= tail
                        starts = first[symbol]
                        tail = (starts - {""}) | (tail if "" in starts else set())
                    else:
                        tail = {symbol}
                if left != "^":
                    starts = {""}
                    for symbol in reversed(right):
                        own = first.get(symbol, {symbol})
                        starts = (own - {""}) | (starts if "" in own else set())
                    first[left] |= starts
            if sum(map(len, [*first.values(), *follow.values()])) == before:
                return follow


class StackGraph:
    """All stacks of an automaton as numbered nodes; node 0 is the empty parse.

    The nodes that shifts can reach must be finitely many, as they are for
    left-recursive regular grammars.
    """

    MOST = 64

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.nodes: list[tuple[int, int | None]] = [(0, None)]
        self.number = {(0, None): 0}
        terminals = sorted({c for _, right in automaton.rules for c in right if c not in automaton.grammar})
        self.moves: list[dict[str, tuple[int, ...]]] = []
        self.accepts: set[int] = set()
        reached, seen = [0], {0}
        while reached:
            node = reached.pop()
            while len(self.moves) <= node:
                self.moves.append({})
            self.moves[node] = {t: self._shift(node, t) for t in terminals}
            if any(self.nodes[n][0] == automaton.goto[0, automaton.rules[0][1]] for n in self._reduced(node, _END)):
                self.accepts.add(node)
            for ahead in self.moves[node].values():
                new = [n for n in ahead if n not in seen]
                seen.update(new), reached.extend(new)
            if len(seen) > self.MOST:
                raise ValueError("the grammar's stacks have no bound")
        self.live = sorted(seen)

    def _node(self, state: int, below: int | None) -> int:
        if (state, below) not in self.number:
            self.number[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.number[state, below]

    def _reduced(self, node: int, ahead: str) -> set[int]:
        """The node and all that reductions under the lookahead make of it."""
        lr, found, todo = self.automaton, {node}, [node]
        while todo:
            top = todo.pop()
            for rule, at in lr.states[self.nodes[top][0]]:
                left, right = lr.rules[rule]
                if rule == 0 or at < len(right) or ahead not in lr.follow[left]:
                    continue
                below = top
                for _ in right:
                    below = self.nodes[below][1]
                made = self._node(lr.goto[self.nodes[below][0], left], below)
                if made not in found:
                    found.add(made), todo.append(made)
        return found

    def _shift(self, node: int, terminal: str) -> tuple[int, ...]:
        goto = self.automaton.goto
        tops = self._reduced(node, terminal)
        return tuple(sorted({self._node(goto[self.nodes[n][0], terminal], n) for n in tops if (self.nodes[n][0], terminal) in goto}))


GRAPH = StackGraph(Automaton(ROLE_GRAMMAR))


def _offer(stacks: dict[int, Weight], node: int, weight: Weight) -> bool:
    if node not in stacks or weight < stacks[node]:
        stacks[node] = weight
        return True
    return False


def with_inserts(stacks: dict[int, Weight]) -> dict[int, Weight]:
    """The stacks and all that inserted rows lead to."""
    todo = list(stacks)
    while todo:
        node = todo.pop()
        cost, audit = stacks[node]
        for role in MADE:
            for ahead in GRAPH.moves[node].get(role, ()):
                if _offer(stacks, ahead, (cost + INSERT, audit + "I")):
                    todo.append(ahead)
    return stacks


def after_row(stacks: dict[int, Weight], row: str) -> dict[int, Weight]:
    """Stacks after one row: s, u, a or x (any other role), upper case if truncated; d must go."""
    new: dict[int, Weight] = {}
    for node, (cost, audit) in stacks.items():
        _offer(new, node, (cost + DELETE, audit + "D"))
        if row == "d":
            continue
        cost += CUT if row.isupper() else 0
        for ahead in GRAPH.moves[node].get(row.lower(), ()):
            _offer(new, ahead, (cost + KEEP, audit + "K"))
        for role in MADE:
            for ahead in GRAPH.moves[node].get(role, ()):
                _offer(new, ahead, (cost + REROLE, audit + "R"))
    return with_inserts(new)


@lru_cache(maxsize=1 << 14)
def _short(start: int, rows: str) -> dict[int, Weight]:
    return _table(start, rows)


def _table(start: int, rows: str) -> dict[int, Weight]:
    stacks = with_inserts({start: (0, "")})
    for row in rows:
        stacks = after_row(stacks, row)
    return stacks


def block_table(start: int, rows: str) -> dict[int, Weight]:
    """End stack to the least (cost, audit) over a block's rows from a start stack; not to be changed."""
    return _short(start, rows) if len(rows) <= 32 else _table(start, rows)


class Fold:
    """The least (cost, audit) path through the blocks of one conversation, without keeping their audits.

    Audits of equal numbers of rows differ before the inserts at their ends or
    are equal there, so per stack the rank of the audit without those inserts,
    and their number, decide every later comparison exactly.
    """

    def __init__(self) -> None:
        self.now: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}  # stack: cost, rank, inserts at the end
        self.back: list[dict[int, int]] = []

    def add(self, tables: dict[int, dict[int, Weight]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, (cost, rank, inserts) in self.now.items():
            for end, (more, audit) in tables.get(start, {}).items():
                way = (cost + more, rank, "I" * inserts + audit, start)
                if end not in best or way < best[end]:
                    best[end] = way
        stems = {end: (rank, audit.rstrip("I")) for end, (_, rank, audit, _) in best.items()}
        order = {stem: i for i, stem in enumerate(sorted(set(stems.values())))}
        self.now = {end: (way[0], order[stems[end]], len(way[2]) - len(stems[end][1])) for end, way in best.items()}
        self.back.append({end: way[3] for end, way in best.items()})

    def path(self) -> tuple[int, list[tuple[int, int]]]:
        """(cost, [(start, end) of each block])."""
        cost, _, _, end = min((c, r, "I" * i, n) for n, (c, r, i) in self.now.items() if n in GRAPH.accepts)
        steps = []
        for back in reversed(self.back):
            steps.append((back[end], end))
            end = back[end]
        return cost, steps[::-1]
