"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are compiled together: parsed into a byte automaton
with empty moves, made deterministic by subset construction, and minimised by
splitting classes of states. The result is a transition array over classes of
bytes. One pass over a text's bytes runs every rule at once: the automaton searches
for all rules from every position, and the state says which rules have just been
matched; it stops at a rule's shortest match. There the rule's own reversed automaton walks back to the
leftmost start, and its anchored one forward to the longest end; a rule's spans
never overlap. Both walks stay within the match.

This gives leftmost-longest spans for rules in which no match begins inside
another's match before that one's first end, which `RULES` keep. The language of
rules: literals, `[...]` classes, groups, `|`, `?`, `*`, `+`. Lengths are told by
`least` after the match, and a failing match is dropped with no retry, as the
longest run is taken whole. `hex` has its length in the automaton instead, which
comes to the same as runs of one class are maximal.

Offsets are code points, ends exclusive. Null and empty texts have no spans; null
ids stay null; repeated rows are scanned each by itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of, texts


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  #: bytes of the span without its head
    head: str = ""  #: what `pattern` begins with that does not count


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base rules, in the order in which spans that start alike are told.
_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))
_ASSIGN = f"""({_KEYS})["']? *[:=] *["']?"""
BASE = (
    Rule("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", least=12, head=_ASSIGN),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]" * 16 + "[0-9a-f]*"),
)
# Rules that the method adds.
ADDED = (
    Rule("hub", "gh(p|o|u|s|r)_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox(b|a|p|r|s)-[A-Za-z0-9-]+", least=24),
    Rule("cloud", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_.-]+", least=40),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + ADDED
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


# --------------------------------------------------------- pattern to automaton


def parse(pattern: str):
    """A tree of ("set", bytes) | ("cat", parts) | ("or", parts) | ("many", part, least, endless)."""
    at = 0

    def peek():
        return pattern[at] if at < len(pattern) else ""

    def take():
        nonlocal at
        at += 1
        return pattern[at - 1]

    def klass():
        out = set()
        while peek() != "]":
            c = take()
            if peek() == "-" and pattern[at + 1 : at + 2] not in ("]", ""):
                take()
                out |= set(range(ord(c), ord(take()) + 1))
            else:
                out.add(ord(c))
        take()
        return frozenset(out)

    def either():
        parts = [sequence()]
        while peek() == "|":
            take()
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        parts = []
        while peek() not in ("", "|", ")"):
            c = take()
            if c == "(":
                part = either()
                take()
            else:
                part = ("set", klass() if c == "[" else frozenset(c.encode()))
            while peek() in ("?", "*", "+") and peek():
                part = ("many", part, *{"?": (0, False), "*": (0, True), "+": (1, True)}[take()])
            parts.append(part)
        return ("cat", parts)

    return either()


def reverse(tree):
    kind, *rest = tree
    if kind == "set":
        return tree
    if kind == "many":
        return (kind, reverse(rest[0]), *rest[1:])
    return (kind, [reverse(x) for x in (rest[0][::-1] if kind == "cat" else rest[0])])


def shortest(tree):
    """The tree of the shortest matches: with no repetition at its end."""
    kind, *rest = tree
    if kind == "or":
        return (kind, [shortest(x) for x in rest[0]])
    if kind == "many":
        return shortest(rest[0]) if rest[1] else ("cat", [])
    if kind == "cat" and rest[0]:
        last = shortest(rest[0][-1])
        return ("cat", [*rest[0][:-1], last]) if last != ("cat", []) else shortest(("cat", rest[0][:-1]))
    return tree


class Moves:
    """An automaton with empty moves."""

    def __init__(self):
        self.empty, self.on = [], []

    def state(self) -> int:
        self.empty.append([])
        self.on.append([])
        return len(self.on) - 1

    def add(self, tree, start: int) -> int:
        """Lay out `tree` from `start`; the state where it ends."""
        kind, *rest = tree
        if kind == "set":
            end = self.state()
            self.on[start].append((rest[0], end))
        elif kind == "cat":
            end = start
            for x in rest[0]:
                end = self.add(x, end)
        elif kind == "or":
            end = self.state()
            for x in rest[0]:
                self.empty[self.add(x, start_x := self.state())].append(end)
                self.empty[start].append(start_x)
        else:
            part, least, endless = rest
            first, end = self.state(), self.state()
            self.empty[start].append(first)
            last = self.add(part, first)
            self.empty[last].append(end)
            if not least:
                self.empty[start].append(end)
            if endless:
                self.empty[last].append(first)
        return end

    def closed(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """`step[state * classes + class_of[byte]]`; state 0 is the start, `dead` has no way on.

    `marks[state]` has the numbers of the rules that end there."""

    class_of: bytes
    classes: int
    step: tuple[int, ...]
    marks: tuple[tuple[int, ...], ...]
    dead: int


def determinise(trees: list, search: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation. search: from every position."""
    m = Moves()
    start = m.state()
    ends = {}
    for k, tree in enumerate(trees):
        first = m.state()
        m.empty[start].append(first)
        ends[m.add(tree, first)] = k
    sets = {s for row in m.on for s, _ in row}
    signs = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(signs))}
    class_of = bytes(numbers[x] for x in signs)
    sample = [class_of.index(c) for c in range(len(numbers))]
    base = m.closed([start])
    seen, todo, rows = {base: 0}, [base], []
    for subset in todo:
        row = []
        for byte in sample:
            to = {t for s in subset for bytes_, t in m.on[s] if byte in bytes_}
            nxt = m.closed(to | base if search else to)
            if nxt not in seen:
                seen[nxt] = len(seen)
                todo.append(nxt)
            row.append(seen[nxt])
        rows.append(row)
    marks = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in todo]
    step = np.array(rows)
    # States stay together as long as their marks and their successors' classes agree.
    kinds = {x: i for i, x in enumerate(dict.fromkeys(marks))}
    group = np.array([kinds[x] for x in marks])
    while True:
        _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        if finer.max() == group.max():
            break
        group = finer
    first = {g: i for i, g in reversed(list(enumerate(group.tolist())))}
    order = sorted(first, key=first.get)  # the start's class comes first
    number = {g: i for i, g in enumerate(order)}
    table = [[number[group[t]] for t in rows[first[g]]] for g in order]
    out_marks = tuple(marks[first[g]] for g in order)
    dead = next((i for i, r in enumerate(table) if set(r) == {i} and not out_marks[i]), -1)
    return Automaton(class_of, len(numbers), tuple(x for r in table for x in r), out_marks, dead)


class Scanner:
    """The combined searching automaton, and each rule's two walks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern) for r in rules]
        self.search = determinise([shortest(t) for t in trees], search=True)
        self.back = [determinise([reverse(t)], search=False) for t in trees]
        self.ahead = [determinise([t], search=False) for t in trees]
        n = self.search.classes
        # A list of rows keeps the pass to two lookups a byte; rows of marked states are told by a flag.
        self.rows: list = [[] for _ in self.search.marks]
        self.marked = [bool(x) for x in self.search.marks]
        for s, row in enumerate(self.rows):
            row += [self.search.step[s * n + c] for c in range(n)]
        self.heads = [re.compile(r.head.encode()) for r in rules]

    @staticmethod
    def walk(a: Automaton, data: bytes, positions: range) -> int:
        """How many bytes the longest match takes along `positions`; 0 if none."""
        state = taken = 0
        for k, i in enumerate(positions, 1):
            state = a.step[state * a.classes + a.class_of[data[i]]]
            if state == a.dead:
                break
            if a.marks[state]:
                taken = k
        return taken

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in ascending order."""
        hits = self._hits(data)
        over, out = [0] * len(self.rules), []
        for at, state in hits:
            for r in self.search.marks[state]:
                if at < over[r]:  # inside the rule's last match
                    continue
                n = self.walk(self.back[r], data, range(at, over[r] - 1, -1))
                if not n:  # the match would begin inside the last one
                    continue
                start = at - n + 1
                end = start + self.walk(self.ahead[r], data, range(start, len(data)))
                over[r] = end
                if end - self.heads[r].match(data, start, end).end() >= self.rules[r].least:
                    out.append((start, r, end))
        return sorted(out)

    def _hits(self, data: bytes) -> list[tuple[int, int]]:
        """(position, state) wherever the one pass over the bytes is in a marked state."""
        rows, marked, out = self.rows, self.marked, []
        row, i = rows[0], -1
        for c in data.translate(self.search.class_of):
            i += 1
            state = row[c]
            row = rows[state]
            if marked[state]:
                out.append((i, state))
        return out


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, in code points, by start and then the rules' order."""
    out, at, points = [], 0, 0
    found = scanner(rules).spans(data)
    offsets = {}
    for p in sorted({p for s, _, e in found for p in (s, e)}):
        points += len(data[at:p].decode("utf-8", "replace"))
        at, offsets[p] = p, points
    for s, r, e in found:
        out.append((offsets[s], offsets[e], rules[r].kind))
    return out


def told(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """COLUMNS of every document. `spans` are all spans, `base_sha256` is of the base kinds' spans."""
    base = [r.kind for r in BASE]

    def find(batches):
        for ids, data in rows_of(batches, "doc_id", "text"):
            spans = [scan(x or b"", rules) for x in data]
            counts = [[sum(k == b for _, _, k in s) for s in spans] for b in base]
            sha = [hashlib.sha256(told(x for x in s if x[2] in base).encode()).hexdigest() for s in spans]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([told(s) for s in spans], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COLUMNS.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(find, COLUMNS)
