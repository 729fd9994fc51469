"""Secret scans with one deterministic automaton for all rules.

A rule is a short ``seek`` (which tells it from other text) and a ``rest``, both regular expressions over bytes (literals, classes,
groups, |, ?, *, +, {m}, {m,}). The seeks of all rules become one nondeterministic automaton that may start anywhere; subset
construction makes it deterministic over classes of bytes, and partition refinement minimises it. A text is read once, byte by byte,
for all rules together. Where the automaton accepts, a rule's reversed seek, made deterministic in the same way, leads back to
the start, and its rest leads on to the end of the longest match: all spans come from transition arrays. Long repetitions stand
in the rests, so that the counters of different rules don't multiply in the one automaton. Seeks of one rule must not nest: those that
end first start first. All arrays are built once and sent to the workers.

Two kinds of spans are returned. Base spans are the leftmost matches, not overlapping within a rule, of its loose form, without
those that are too short; the spans that the automaton adds are matches of the strict form elsewhere (such as a secret behind
a short value that the loose form had swallowed) and of the rules that have no base spans: public token formats, and private
keys from the first line to the last (the first line alone where the last is missing). All steps are linear in the text.

Defined cases: a null text counts as empty; repeated rows get equal results; an empty table gives an empty table; extra columns
are ignored. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import bytes_of


@dataclass(frozen=True)
class Rule:
    """A match is ``seek`` followed by ``rest``, not behind a byte of the class ``behind``.

    Only a ``base`` rule has base spans: matches of ``seek`` and ``loose`` (``rest``, where there is none) that ``rest`` matches as well.
    """

    kind: str
    seek: str
    rest: str
    base: bool = False
    loose: str | None = None
    behind: str = ""

    @property
    def strict(self) -> str:
        """The whole rule as one expression."""
        return (f"(?<![{self.behind}])" if self.behind else "") + f"(?:{self.seek})(?:{self.rest})"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORD = "(" + "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]) + ")"
_VALUE = "[A-Za-z0-9+/_.=-]"
_URL64 = "[A-Za-z0-9_-]"
_INSIDE = r"[\x09-\x0D\x20A-Za-z0-9+/=:,]"
RULES = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?""" + _VALUE, _VALUE + "{5,}", base=True, loose=_VALUE + "*"),
    Rule("access", "AKIA", "[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24}", "[0-9a-f]*", base=True),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", f"((-?-?-?-?{_INSIDE})*-----END [A-Z ]*PRIVATE KEY-----)?"),
    # public formats of service tokens (fixed values)
    Rule("github", "gh[pousr]_[A-Za-z0-9]", "[A-Za-z0-9]{35,}"),
    Rule("github_fine", "github_pat_", "[A-Za-z0-9_]{22,}"),
    Rule("slack", "xox[abeoprs]-", "[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza", _URL64 + "{35}"),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ", rf"{_URL64}+\.eyJ{_URL64}+\.{_URL64}+", behind=_URL64[1:-1]),
)


class _Nfa:
    """States are numbers; ``free`` moves take no byte, ``moves`` take one of a set of bytes."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append(None)
        return len(self.free) - 1

    def compile(self, pattern: str) -> tuple[int, int]:
        self.left, self.at = pattern, 0
        out = self._either()
        if self.at != len(pattern):
            raise ValueError(f"at {self.at} in {pattern}")
        return out

    def _peek(self) -> str:
        return self.left[self.at] if self.at < len(self.left) else ""

    def _either(self) -> tuple[int, int]:
        ends = [self._chain()]
        while self._peek() == "|":
            self.at += 1
            ends.append(self._chain())
        if len(ends) == 1:
            return ends[0]
        a, b = self.state(), self.state()
        for x, y in ends:
            self.free[a].append(x)
            self.free[y].append(b)
        return a, b

    def _chain(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            a, b = self._atom()
            least, most = self._times()
            after, copies = self.at, []
            for _ in range(max(least, 1)):  # an atom is compiled again for each copy
                if copies:
                    self.at = begin
                    a, b = self._atom()
                copies.append((a, b))
            self.at = after
            if least == 0:
                self.free[copies[0][0]].append(copies[0][1])
            if most is None:
                self.free[copies[-1][1]].append(copies[-1][0])
            for a, b in copies:
                self.free[last].append(a)
                last = b
        return first, last

    def _times(self) -> tuple[int, int | None]:
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if m := re.compile(r"\{(\d+)(,?)\}").match(self.left, self.at):
            self.at = m.end()
            return int(m[1]), None if m[2] else int(m[1])
        return 1, 1

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        if c == "(":
            self.at += 1
            out = self._either()
            self.at += 1
            return out
        a, b = self.state(), self.state()
        self.moves[a] = (self._class() if c == "[" else frozenset([self._byte()]), b)
        return a, b

    def _byte(self) -> int:
        c = self.left[self.at]
        self.at += 1
        if c == "\\":
            if self.left[self.at] == "x":
                self.at += 3
                return int(self.left[self.at - 2 : self.at], 16)
            self.at += 1
            return ord(self.left[self.at - 1])
        return ord(c)

    def _class(self) -> frozenset[int]:
        self.at += 1
        found: set[int] = set()
        while self._peek() != "]":
            a = self._byte()
            if self._peek() == "-" and self.left[self.at + 1] != "]":
                self.at += 1
                found.update(range(a, self._byte() + 1))
            else:
                found.add(a)
        self.at += 1
        return frozenset(found)

    def reversed(self) -> _Nfa:
        """The same states, all moves turned round (each state is the target of one move at most)."""
        out = _Nfa()
        for _ in self.free:
            out.state()
        for a, (free, move) in enumerate(zip(self.free, self.moves)):
            for b in free:
                out.free[b].append(a)
            if move:
                out.moves[move[1]] = (move[0], a)
        return out

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        found, left = set(states), list(states)
        while left:
            for x in self.free[left.pop()]:
                if x not in found:
                    found.add(x)
                    left.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """next[state * classes + class_of[byte]] is the next state times ``classes``; states from ``accepting`` on accept.

    ``start`` and ``dead`` are states times ``classes``; nothing that goes through ``dead`` is accepted (-1: there is no such state).
    """

    class_of: bytes
    classes: int
    next: tuple[int, ...]
    accepting: int
    accepts: tuple[int, ...]
    start: int
    dead: int


def _minimal(table: np.ndarray, accepts: np.ndarray) -> np.ndarray:
    """The block of each state: states of a block accept the same rules after every input (Moore's refinement)."""
    _, block = np.unique(accepts, return_inverse=True)
    count = block.max() + 1
    while True:
        old = block
        for column in table.T:  # blocks split by where each class of bytes leads
            _, block = np.unique(block * count + old[column], return_inverse=True)
        if block.max() + 1 == count:
            return block
        count = block.max() + 1


@lru_cache(maxsize=64)
def automaton(patterns: tuple[str, ...], anywhere: bool = True, back: bool = False) -> Automaton:
    """One minimal deterministic automaton; state s accepts pattern i if a match of it ends here.

    Matches start ``anywhere`` or only at the first byte; with ``back`` it reads bytes from the last of a match to the first.
    """
    nfa = _Nfa()
    ends = [nfa.compile(p) for p in patterns]
    if back:
        nfa, ends = nfa.reversed(), [(b, a) for a, b in ends]
    sets = {m[0] for m in nfa.moves if m}
    member = np.array([[b in s for s in sets] for b in range(256)])
    _, first, class_of = np.unique(member, axis=0, return_index=True, return_inverse=True)
    class_of = class_of.ravel()
    begin = nfa.closure(frozenset(a for a, _ in ends))
    final = {b: 1 << i for i, (_, b) in enumerate(ends)}
    # sets of states as bits; only states that take a byte or accept tell sets apart
    telling = sum(1 << i for i, m in enumerate(nfa.moves) if m or i in final)

    def bits(states: frozenset[int]) -> int:
        return sum(1 << s for s in states) & telling

    reach: list[list[tuple[int, int]]] = [[] for _ in nfa.moves]  # by a byte of which class, to what
    for s, m in enumerate(nfa.moves):
        if m:
            target = bits(nfa.closure(frozenset([m[1]])))
            reach[s] = [(c, target) for c in range(len(first)) if int(first[c]) in m[0]]
    start = bits(begin)
    number, todo, rows, accepts = {start: 0}, [start], [], []
    while len(rows) < len(todo):
        states, row, accepted = todo[len(rows)], [start if anywhere else 0] * len(first), 0
        while states:
            s = (states & -states).bit_length() - 1
            states &= states - 1
            accepted |= final.get(s, 0)
            for c, target in reach[s]:
                row[c] |= target
        for target in row:
            if target not in number:
                number[target] = len(todo)
                todo.append(target)
        rows.append([number[target] for target in row])
        accepts.append(accepted)
    table, accepted = np.array(rows), np.array(accepts)
    block = _minimal(table, accepted)
    _, pick = np.unique(block, return_index=True)
    order = np.lexsort((pick, accepted[pick] > 0))  # accepting states last, otherwise as found
    place = np.empty(len(pick), np.int64)
    place[order] = np.arange(len(pick))
    small = place[block[table[pick[order]]]]
    classes = len(first)
    rules = accepted[pick[order]]
    dead = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (rules == 0))
    return Automaton(
        bytes(class_of.astype(np.uint8)), classes, tuple((small * classes).ravel().tolist()), int((rules == 0).sum()), tuple(rules.tolist()),
        int(place[block[0]]) * classes, int(dead[0]) * classes if len(dead) else -1,
    )


def accepted_rules(data: bytes, dfa: Automaton) -> int:
    """The rules (as bits) whose seeks match somewhere, from one pass over the bytes."""
    found, state, step, least = 0, dfa.start, dfa.next, dfa.accepting * dfa.classes
    for c in data.translate(dfa.class_of):
        state = step[state + c]
        if state >= least:
            found |= dfa.accepts[state // dfa.classes]
    return found


def longest(data: bytes, at: int, dfa: Automaton) -> int:
    """Where the longest match that starts at ``at`` ends; -1 without one."""
    state, step, class_of, dead, least = dfa.start, dfa.next, dfa.class_of, dfa.dead, dfa.accepting * dfa.classes
    end = at if state >= least else -1
    for at in range(at, len(data)):
        state = step[state + class_of[data[at]]]
        if state == dead:
            break
        if state >= least:
            end = at + 1
    return end


def leftmost(data: bytes, end: int, dfa: Automaton, behind: frozenset[int]) -> int:
    """Where the first match that ends at ``end`` starts, not behind a byte of ``behind``; -1 without one. ``dfa`` reads backwards."""
    state, step, class_of, dead, least = dfa.start, dfa.next, dfa.class_of, dfa.dead, dfa.accepting * dfa.classes
    start = -1
    for at in range(end - 1, -1, -1):
        state = step[state + class_of[data[at]]]
        if state == dead:
            break
        if state >= least and not (at and data[at - 1] in behind):
            start = at
    return start


@dataclass(frozen=True)
class Tables:
    """The one automaton of all seeks; by rule, the reversed seek, the rest, the loose rest and the bytes of ``behind``."""

    dfa: Automaton
    back: tuple[Automaton, ...]
    rest: tuple[Automaton, ...]
    loose: tuple[Automaton | None, ...]
    behind: tuple[frozenset[int], ...]


@lru_cache(maxsize=4)
def tables(rules: tuple[Rule, ...]) -> Tables:
    def ahead(pattern: str) -> Automaton:
        return automaton((pattern,), anywhere=False)

    def members(inside: str) -> frozenset[int]:
        nfa = _Nfa()
        nfa.compile(f"[{inside}]" if inside else "")
        return frozenset().union(*(m[0] for m in nfa.moves if m))

    return Tables(
        automaton(tuple(r.seek for r in rules)), tuple(automaton((r.seek,), anywhere=False, back=True) for r in rules), tuple(ahead(r.rest) for r in rules),
        tuple(ahead(r.loose or r.rest) if r.base else None for r in rules), tuple(members(r.behind) for r in rules),
    )


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, made: Tables | None = None):
        self.rules = rules
        self.made = made or tables(rules)
        self.dfa = self.made.dfa
        self.at = {s * self.dfa.classes: [k for k in range(len(rules)) if bits >> k & 1] for s, bits in enumerate(self.dfa.accepts) if bits}

    def spans(self, text: str | None) -> list[tuple[int, int, int, bool]]:
        """(rule number, start, end, base), by start, then rule."""
        data = bytes_of(text)
        base: list[list[tuple[int, int]]] = [[] for _ in self.rules]
        strict: list[list[tuple[int, int]]] = [[] for _ in self.rules]
        base_done, done = [0 if m else len(data) for m in self.made.loose], [0] * len(self.rules)  # no match starts before
        state, step, least = self.dfa.start, self.dfa.next, self.dfa.accepting * self.dfa.classes
        for here, c in enumerate(data.translate(self.dfa.class_of), 1):
            state = step[state + c]
            if state < least:
                continue
            for k in self.at[state]:
                if here <= done[k] and here <= base_done[k]:
                    continue
                start = leftmost(data, here, self.made.back[k], self.made.behind[k])
                if start < 0 or (start < done[k] and start < base_done[k]):
                    continue
                end = longest(data, here, self.made.rest[k])
                if start >= base_done[k] and (loose := longest(data, here, self.made.loose[k])) >= 0:
                    base_done[k] = loose
                    if end >= 0:
                        base[k].append((start, loose))
                if start >= done[k] and end >= 0:
                    done[k] = end
                    strict[k].append((start, end))
        out = []
        for k, found in enumerate(strict):
            own, at = base[k], 0
            out += [(k, a, b, True) for a, b in own]
            for a, b in found:  # both lists ascend and neither overlaps itself: they are merged
                while at < len(own) and own[at][1] <= a:
                    at += 1
                if at == len(own) or own[at][0] >= b:
                    out.append((k, a, b, False))
        if out and len(data) != len(text or ""):  # bytes to code points: how many begin before
            before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
            out = [(k, int(before[a]), int(before[b]), is_base) for k, a, b, is_base in out]
        return sorted(out, key=lambda s: (s[1], s[0], s[2]))


SPANS = ArrayType(StructType([StructField("rule", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("base", BooleanType())]))
_SPAN = pa.struct([("rule", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and secrets, an array of struct<rule, start, end, base> with rule numbers from 0."""
    made = docs.sparkSession.sparkContext.broadcast(tables(rules))  # as large as the rules make it

    def find(texts: pa.Array) -> pa.Array:
        scanner = Scanner(rules, made.value)
        found = [[dict(zip(("rule", "start", "end", "base"), s)) for s in scanner.spans(t.as_py())] for t in texts]
        return pa.array(found, pa.list_(_SPAN))

    return docs.select(F.col(id_col), F.arrow_udf(find, SPANS)(text_col).alias("secrets"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the sha256 of these, and all spans as text."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["base"])

    def count(k: int):
        return F.size(F.filter(base, lambda s: s["rule"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    counts = [count(k) for k, r in enumerate(rules) if r.base]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
