"""One deterministic automaton out of many patterns, run over many places at once in numpy.

`compile_rules` takes ordinary regular expressions (literals, classes, groups, alternatives,
greedy repeats, ``(?i:...)``), joins them into one nondeterministic automaton and makes that
deterministic by subset construction over classes of equivalent characters. `Automaton.longest`
starts it at many places of a text array and steps all of them together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

parse = re._parser.parse
C = re._constants
OTHER = 128  # every character beyond ASCII
_ALL = frozenset(range(129))
_CATEGORIES = {
    C.CATEGORY_SPACE: frozenset(b" \t\n\r\f\v"),
    C.CATEGORY_DIGIT: frozenset(b"0123456789"),
    C.CATEGORY_WORD: frozenset(i for i in range(128) if chr(i).isalnum() or i == 95) | {OTHER},
}
_CATEGORIES |= {C.CATEGORY_NOT_SPACE: _ALL - _CATEGORIES[C.CATEGORY_SPACE], C.CATEGORY_NOT_DIGIT: _ALL - _CATEGORIES[C.CATEGORY_DIGIT], C.CATEGORY_NOT_WORD: _ALL - _CATEGORIES[C.CATEGORY_WORD]}


def _both_cases(chars: frozenset[int]) -> frozenset[int]:
    return frozenset(y for x in chars for y in ({ord(chr(x).lower()), ord(chr(x).upper())} if x < 128 else {x}))


class _Nfa:
    def __init__(self, most_repeats: int):
        self.most = most_repeats
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.jumps: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.jumps.append([])
        return len(self.steps) - 1

    def add(self, items, at: int, fold: bool) -> int:
        """Adds a sequence after state at; returns its last state."""
        for op, arg in items:
            if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                chars = self._chars(op, arg, fold)
                to = self.state()
                self.steps[at].append((chars, to))
                at = to
            elif op is C.BRANCH:
                end = self.state()
                for option in arg[1]:
                    first = self.state()
                    self.jumps[at].append(first)
                    self.jumps[self.add(option, first, fold)].append(end)
                at = end
            elif op is C.SUBPATTERN:
                at = self.add(arg[3], at, (fold or bool(arg[1] & re.I)) and not arg[2] & re.I)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                low, high, inner = arg
                if low > self.most or high is not C.MAXREPEAT and high > self.most:
                    raise ValueError(f"counts above {self.most} are not supported")
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is C.MAXREPEAT:
                    loop = self.state()
                    self.jumps[at].append(loop)
                    self.jumps[self.add(inner, loop, fold)].append(loop)
                    at = self.state()
                    self.jumps[loop].append(at)
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.jumps[at].append(end)
                        at = self.add(inner, at, fold)
                    self.jumps[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported: {op}")
        return at

    @staticmethod
    def _chars(op, arg, fold: bool) -> frozenset[int]:
        if op is C.ANY:
            return _ALL - {10}
        if op is C.LITERAL or op is C.NOT_LITERAL:
            chars = frozenset([min(arg, OTHER)])
            chars = _both_cases(chars) if fold else chars
            return chars if op is C.LITERAL else _ALL - chars
        negate, out = False, set()
        for kind, x in arg:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                out.add(min(x, OTHER))
            elif kind is C.RANGE:
                out |= {min(i, OTHER) for i in range(x[0], min(x[1], OTHER) + 1)}
            elif kind is C.CATEGORY:
                out |= _CATEGORIES[x]
        chars = _both_cases(frozenset(out)) if fold else frozenset(out)
        return _ALL - chars if negate else chars


@dataclass
class Automaton:
    """table[state, class] is the next state, 0 the dead one; accepts[state] is a bit for each rule.

    State 1 begins the rules, state 2 those that may begin inside a run of name characters, and state
    3 the rules kept apart: they share no states with the others, so the counts of these rules don't
    multiply with the others' states.
    """

    names: list[str]
    patterns: list[str]
    classes: np.ndarray  # of each of the 129 characters; the last class ends a text
    table: np.ndarray
    accepts: np.ndarray
    first: np.ndarray  # characters with which a match can begin, for states 1 and 3

    def codes(self, text: np.ndarray) -> np.ndarray:
        """Classes of characters given as code points."""
        return self.classes[np.minimum(text, OTHER)]

    def longest(self, codes: np.ndarray, starts: np.ndarray, state: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each rule (index into starts, end of the longest match) where it matches; and the starts that were alive at the end of their text or of the array.

        state: the state in which each start begins.
        """
        n, stop = len(codes), self.classes[129]
        ends = np.zeros((len(self.names), len(starts)), np.int64)
        lane, at = np.arange(len(starts)), starts.copy()
        unfinished = []
        while len(lane):
            open_ = codes[np.minimum(at, n - 1)] != stop
            open_ &= at < n
            if not open_.all():
                unfinished.append(lane[~open_])
                lane, at, state = lane[open_], at[open_], state[open_]
            state = self.table[state, codes[at]]
            live = state > 0
            if not live.all():
                lane, at, state = lane[live], at[live], state[live]
            at = at + 1
            bits = self.accepts[state]
            hit = np.flatnonzero(bits)
            for r in range(len(self.names)) if len(hit) else ():
                mine = hit[(bits[hit] >> r) & 1 == 1]
                ends[r, lane[mine]] = at[mine]
        out = []
        for r in range(len(self.names)):
            which = np.flatnonzero(ends[r])
            out.append((which, ends[r, which]))
        return out, np.concatenate(unfinished) if unfinished else np.zeros(0, np.int64)


def compile_rules(rules: dict[str, str], anchored: frozenset[str] = frozenset(), apart: frozenset[str] = frozenset(), most_repeats: int = 64, most_states: int = 200_000) -> Automaton:
    """anchored: rules that begin at the first character of a run of name characters only.
    apart: rules that begin in state 3.

    Counts up to most_repeats are exact; rules with higher ones are refused."""
    nfa = _Nfa(most_repeats)
    start, inner, alone = nfa.state(), nfa.state(), nfa.state()
    goal: dict[int, int] = {}
    for r, (name, pattern) in enumerate(rules.items()):
        first = nfa.state()
        nfa.jumps[alone if name in apart else start].append(first)
        if name not in anchored | apart:
            nfa.jumps[inner].append(first)
        tree = parse(pattern)
        goal[nfa.add(tree, first, False)] = 1 << r
    sets = {chars for steps in nfa.steps for chars, _ in steps}
    signature: dict[frozenset, int] = {}
    classes = np.zeros(130, np.int64)
    members: list[int] = []
    ordered = list(sets)
    for c in range(129):
        key = frozenset(i for i, s in enumerate(ordered) if c in s)
        if key not in signature:
            signature[key] = len(signature)
            members.append(c)
        classes[c] = signature[key]
    end_class = len(signature)

    def close(states: frozenset[int]) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for to in nfa.jumps[stack.pop()]:
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
        return frozenset(s for s in seen if nfa.steps[s] or s in goal)

    # a mark keeps the first states apart even where they hold the same rules
    begin = [close(frozenset([x])) | {-1 - k} for k, x in enumerate((start, inner, alone))]
    number, queue, rows = {frozenset(): 0, **{b: k + 1 for k, b in enumerate(begin)}}, list(begin), {0: [0] * (end_class + 1)}
    # the character sets that hold each class, as bits: classes with the same open sets share their next state
    bit = {chars: 1 << i for i, chars in enumerate(ordered)}
    holds = [sum(1 << i for i, chars in enumerate(ordered) if c in chars) for c in members]
    steps_of = [[(bit[chars], to) for chars, to in steps] for steps in nfa.steps]
    closed: dict[frozenset, frozenset] = {}
    while queue:
        here = queue.pop()
        reach: dict[int, set[int]] = {}
        for s in here:
            for mark, to in steps_of[s] if s >= 0 else ():
                reach.setdefault(mark, set()).add(to)
        live, known = sum(reach), {0: 0}
        row = []
        for held in holds:
            key = held & live
            if key not in known:
                to = frozenset().union(*[states for mark, states in reach.items() if mark & key])
                if to not in closed:
                    closed[to] = close(to)
                to = closed[to]
                if to not in number:
                    number[to] = len(number)
                    if len(number) > most_states:
                        raise ValueError("the automaton is too large")
                    queue.append(to)
                known[key] = number[to]
            row.append(known[key])
        rows[number[here]] = [*row, 0]
    table = np.array([rows[i] for i in range(len(number))], np.int32)
    accepts = np.zeros(len(number), np.int64)
    for states, i in number.items():
        for s in states:
            accepts[i] |= goal.get(s, 0)
    classes[129] = end_class
    first = np.array([[table[x, classes[c]] > 0 for c in range(129)] for x in (1, 3)])
    return Automaton(list(rules), list(rules.values()), classes, table, accepts, first)
