"""Secret scans with one combined deterministic automaton.

The rules' regular expressions are parsed to one nondeterministic automaton over bytes, made deterministic
by subset construction and minimised; the result is a flat array of transitions. It reads the text backwards
and reports, for all rules in one pass over the bytes, where a match can begin. At a reported place the
rule's own automaton, anchored there, gives the longest match. So matches are leftmost, longest and
non-overlapping per rule, and only matched bytes are read a second time.

Syntax: characters, `\\x` escapes, classes, groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}`, `{m,n}`; ASCII only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, keep_only


@dataclass(frozen=True)
class Rule:
    """A match is `before` and then `value`, both longest; it counts if the value has `least` characters.

    A match that is too short is dropped, but text it covers is not searched again.
    """

    kind: str
    before: str
    value: str
    least: int = 1
    any_case: str = ""  # letters of `before` match in either case if "before"


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, "before"),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 14),
    Rule("hex", r"", r"[0-9a-f]{16,}", 16),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_", r"[A-Za-z0-9]+", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-----", 5),
)


# --- regular expression -> nondeterministic automaton ---------------------------------------------------

class _Parser:
    """Makes a tree: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.p, self.i, self.any_case = pattern.encode("ascii"), 0, any_case

    def _peek(self) -> int:
        return self.p[self.i] if self.i < len(self.p) else -1

    def _set(self, values) -> tuple:
        found = set(values)
        if self.any_case:
            found |= {ord(chr(c).swapcase()) for c in found if chr(c).isalpha()}
        return ("set", frozenset(found))

    def _escaped(self) -> int:
        self.i += 1
        c = self.p[self.i]
        self.i += 1
        if c == ord("x"):
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {ord("t"): 9, ord("n"): 10, ord("r"): 13}.get(c, c)

    def _one(self) -> int:
        if self._peek() == ord("\\"):
            return self._escaped()
        self.i += 1
        return self.p[self.i - 1]

    def either(self) -> tuple:
        parts = [self.sequence()]
        while self._peek() == ord("|"):
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", tuple(parts))

    def sequence(self) -> tuple:
        parts = []
        while self._peek() not in (-1, ord("|"), ord(")")):
            parts.append(self.repeated())
        return ("cat", tuple(parts))

    def repeated(self) -> tuple:
        part = self.atom()
        while (c := self._peek()) in tuple(b"?*+{"):
            self.i += 1
            least, most = {ord("?"): (0, 1), ord("*"): (0, None), ord("+"): (1, None)}.get(c, (0, 0))
            if c == ord("{"):
                end = self.p.index(b"}", self.i)
                low, comma, high = self.p[self.i : end].partition(b",")
                least, most = int(low), int(low) if not comma else int(high) if high else None
                self.i = end + 1
            part = ("rep", part, least, most)
        return part

    def atom(self) -> tuple:
        c = self._peek()
        if c == ord("("):
            self.i += 1
            inner = self.either()
            self.i += 1
            return inner
        if c != ord("["):
            return self._set([self._one()])
        self.i += 1
        negated = self._peek() == ord("^")
        self.i += negated
        values: set[int] = set()
        while self._peek() != ord("]"):
            low = self._one()
            if self._peek() == ord("-") and self.p[self.i + 1] != ord("]"):
                self.i += 1
                values.update(range(low, self._one() + 1))
            else:
                values.add(low)
        self.i += 1
        return self._set(set(range(256)) - values if negated else values)


def parsed(pattern: str, any_case: bool = False) -> tuple:
    return _Parser(pattern, any_case).either()


def _reversed(tree: tuple) -> tuple:
    if tree[0] == "cat":
        return ("cat", tuple(_reversed(t) for t in reversed(tree[1])))
    if tree[0] == "alt":
        return ("alt", tuple(_reversed(t) for t in tree[1]))
    return ("rep", _reversed(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Hang the tree on a state; gives the state in which it ends."""
        if tree[0] == "set":
            end = self.state()
            mid = self.state()
            self.empty[start].append(mid)
            self.moves[mid] = (tree[1], end)
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if tree[0] == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next[state * 256 + byte]; state 0 is the first one; hits[state] lists the rules that accept there.

    States are ordered so that those without hits come before `first_hit`.
    """

    next: tuple
    hits: tuple
    first: int
    first_hit: int
    dead: int


def compiled(trees: list[tuple], everywhere: bool) -> Automaton:
    """One minimal automaton for all trees; everywhere: a match may begin at any place."""
    nfa, ends = _Nfa(), {}
    root = nfa.state()
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(tree, first)] = rule
    start = nfa.closed([root])
    names, todo, rows = {start: 0}, [start], []
    while todo:
        now = todo.pop(0)
        targets: list[set] = [set() for _ in range(256)]
        for s in now:
            if nfa.moves[s]:
                for c in nfa.moves[s][0]:
                    targets[c].add(nfa.moves[s][1])
        row, known = [], {}
        for t in map(frozenset, targets):
            if t not in known:
                known[t] = nfa.closed(t | {root}) if everywhere else nfa.closed(t)
            if known[t] not in names:
                names[known[t]] = len(names)
                todo.append(known[t])
            row.append(names[known[t]])
        rows.append(row)
    marks = [tuple(sorted({ends[s] for s in name if s in ends})) for name in names]
    return _minimal(np.array(rows), marks)


def _minimal(table: np.ndarray, marks: list[tuple]) -> Automaton:
    """Partition refinement: states stay together while they accept alike and move into the same classes."""
    kinds = {m: i for i, m in enumerate(sorted(set(marks)))}
    group = np.array([kinds[m] for m in marks])
    while True:
        _, fresh = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        fresh = fresh.ravel()
        if fresh.max() == group.max():
            break
        group = fresh
    sample = {int(g): i for i, g in enumerate(group)}
    order = sorted(sample, key=lambda g: bool(marks[sample[g]]))
    number = {g: i for i, g in enumerate(order)}
    rows = [[number[int(group[t])] for t in table[sample[g]]] for g in order]
    hits = [marks[sample[g]] for g in order]
    dead = next((i for i, r in enumerate(rows) if not hits[i] and set(r) == {i}), -1)
    return Automaton(tuple(t * 256 for r in rows for t in r), tuple(hits), number[int(group[0])] * 256, 256 * next((i for i, h in enumerate(hits) if h), len(hits)), dead * 256)


# --- scanning -------------------------------------------------------------------------------------------

class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
        self.rules = rules
        before = [parsed(r.before, r.any_case == "before") for r in rules]
        value = [parsed(r.value) for r in rules]
        whole = [("cat", (b, v)) for b, v in zip(before, value)]
        self.begins = compiled([_reversed(t) for t in whole], everywhere=True)
        self.before = [compiled([t], everywhere=False) for t in before]
        self.whole = [compiled([t], everywhere=False) for t in whole]

    @staticmethod
    def _longest(a: Automaton, data: bytes, at: int, stop: int) -> int:
        """End of the longest match from `at` that ends at `stop` or before, or -1."""
        state, end, step, first_hit, dead = a.first, -1, a.next, a.first_hit, a.dead
        if state >= first_hit:
            end = at
        for i in range(at, stop):
            state = step[state + data[i]]
            if state >= first_hit:
                end = i + 1
            elif state == dead:
                break
        return end

    def places(self, data: bytes) -> list[tuple[int, int]]:
        """(place, state) from the last to the first place at which some rule can begin a match."""
        state, step, first_hit, out = self.begins.first, self.begins.next, self.begins.first_hit, []
        at = len(data)
        for b in reversed(data):
            at -= 1
            state = step[state + b]
            if state >= first_hit:
                out.append((at, state))
        return out

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, ends exclusive, sorted by start and then rule."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found, free = [], [0] * len(self.rules)
        for at, state in reversed(self.places(data)):
            for r in self.begins.hits[state >> 8]:
                if at >= free[r]:
                    end = self._longest(self.whole[r], data, at, len(data))
                    free[r] = end
                    # ASCII values: bytes are characters
                    if end - self._longest(self.before[r], data, at, end) >= self.rules[r].least:
                        found.append((at, r, end))
        if not found or len(data) == len(text):
            return found
        cuts = sorted({p for s, _, e in found for p in (s, e)})
        chars, last, total = {}, 0, 0
        for c in cuts:
            total += len(data[last:c].decode("utf-8", "surrogatepass"))
            chars[c], last = total, c
        return [(chars[s], r, chars[e]) for s, r, e in found]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per worker process."""
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row; no shuffle.

    base_sha256 digests the base spans, spans lists all as kind:start:end. Null or empty text: no spans, the
    digest of the empty string. Rows stand alone, so ties, repeated rows and other columns do not matter.
    """
    bounded_batches(docs.sparkSession)
    rules = BASE_RULES + more

    fields = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def scanned(texts: pa.Array) -> pa.Array:
        keep_only()
        s, out = scanner(rules), []
        for text in texts.to_pylist():
            found = s.spans(text)
            base = [f for f in found if f[1] < len(BASE_RULES)]
            named = [[f"{rules[r].kind}:{a}:{b}" for a, r, b in x] for x in (base, found)]
            out.append((*(sum(f[1] == k for f in base) for k in range(3)), hashlib.sha256(",".join(named[0]).encode()).hexdigest(), ",".join(named[1])))
        return pa.array([dict(zip((n for n, _ in fields), row)) for row in out], pa.struct(fields))

    scan = F.arrow_udf(scanned, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("f")).select("doc_id", "f.*")


def redacted(text, mark: str = "[secret]", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES):
    """Column expression: the text with every found span replaced; overlapping spans become one mark."""

    def replaced(texts: pa.Array) -> pa.Array:
        keep_only()

        def one(t):
            out, at, s = [], 0, scanner(rules)
            spans = s.spans(t)
            if not spans:
                return t
            for a, _, b in spans:
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return "".join([*out, t[at:]])

        return pa.array([one(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(replaced, "string")(text)
