"""Secret scan by one combined deterministic automaton.

The rules' regular expressions are parsed into one nondeterministic automaton over bytes
(each with its own accepting mark), made deterministic by subset construction, minimised by
partition refinement and stored as a transition array.  Every byte of every text is read
once for all rules: the lines of a chunk are streams that advance in step, one array
lookup for each position, and the few longest are read to their ends one by one.  A line is a stream of its own as nothing that the automaton looks for
crosses a line feed, which is checked when rules are compiled.

Where the combined automaton has accepted, the spans come from the rule's own automaton, made by the same
construction of its whole pattern: it starts at each place in turn that can begin a match, reads while it can, and the longest
match stands; the next begins after it.  For these rules that is what a regular expression engine finds from left to right, as their
parts leave no choice (tests compare it with re).  The combined automaton holds cut forms of long counted runs, as subsets of their
counters would multiply its states; a cut form accepts within every match that is long enough, so no match is lost.
Only a private key is no regular pattern of one line: from the header that the automaton finds, re takes it over the lines to its end.

Defined results: null text is empty and has no spans; repeated rows give one row each; of spans that begin at one place the rule listed
first is told first; texts of any length are read whole, also in one line.  Other columns are kept by redact(), whatever their names, and ignored by scan().
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.words import chunks

LETTER, DIGIT = "A-Za-z", "0-9"


@dataclass(frozen=True)
class Rule:
    """A match is the pattern; those whose part after the prefix is shorter than least are dropped.  base: of the contract, else added."""

    kind: str
    pattern: str
    prefix: str = ""  # what the pattern begins with and least doesn't count
    least: int = 1
    fold: bool = False
    base: bool = False
    automaton: str = ""  # a pattern with an end in every long enough match, of few states
    lines: bool = False  # the pattern is for re and goes on over lines after what the automaton finds


_KEYWORD = """(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?"""
_PEM = "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"
_GAP = r"""(?:[\s"'>#|*,]|\\+[nrt])"""  # between the lines of a key: also quoted, commented or escaped ones
#: To the END of the same label; without one, over the header fields and base64 lines that follow, a short last line included.  No part is tried twice.
_KEY = (
    r"-----BEGIN (?P<label>(?:[A-Z]+ )*PRIVATE KEY)-----"
    r"(?:(?:[^-]++|-(?!----))*+-----END (?P=label)-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info|Key-Info|Content-Domain|Version|Comment):[^\n\\]*+)*+"
    rf"(?:(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[ \t\r]*(?:\n|\\|[\"']|\Z)))?)?)"
)
#: The three base kinds, and public formats of well-known credentials.
RULES = (
    Rule("assign", _KEYWORD + "([A-Za-z0-9+/_.=-]+)", _KEYWORD, 6, True, True, _KEYWORD + "([A-Za-z0-9+/_.=-]{6})"),
    Rule("access", "AKIA[A-Z0-9]+", "", 20, False, True, "AKIA[A-Z0-9]{4}"),
    Rule("hex", "[0-9a-f]+", "", 24, False, True, "[0-9a-f]{24}"),
    Rule("pem", _KEY, automaton=_PEM, lines=True),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36}", automaton="gh[pousr]_[A-Za-z0-9]{4}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", automaton="xox[abprs]-[A-Za-z0-9-]{2}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", automaton="eyJ[A-Za-z0-9_-]{2}"),
)


class _Nfa:
    """Thompson's construction for literals, classes, groups, | ? * + {n} {m,n} {m,}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        made = self._build(self._choice())
        if self.at != len(pattern):
            raise ValueError(f"unsupported pattern: {pattern}")
        return made

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self):
        options = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            part = self._atom()
            while self._peek() and self._peek() in "?*+{":
                low, high = self._times()
                part = ("times", part, low, high)
            parts.append(part)
        return ("seq", parts)

    def _times(self) -> tuple[int, int | None]:
        sign = self._peek()
        self.at += 1
        if sign != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        stop = self.text.index("}", self.at)
        low, comma, high = self.text[self.at : stop].partition(",")
        self.at = stop + 1
        return int(low), (int(high) if high else None) if comma else int(low)

    def _byte(self) -> int:
        c = self._peek()
        self.at += 1
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def _atom(self):
        if self._peek() == "(":
            self.at += 1
            inner = self._choice()
            self.at += 1
            return inner
        if self._peek() != "[":
            return ("set", self._folded({self._byte()}))
        self.at += 1
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._byte()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._byte()
            found.update(range(low, high + 1))
        self.at += 1
        return ("set", self._folded(found))

    def _folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return frozenset(found)

    def _build(self, node) -> tuple[int, int]:
        first, last = self.state(), self.state()
        if node[0] == "set":
            self.moves[first].append((node[1], last))
        elif node[0] == "or":
            for option in node[1]:
                a, b = self._build(option)
                self.empty[first].append(a)
                self.empty[b].append(last)
        elif node[0] == "seq":
            at = first
            for part in node[1]:
                a, b = self._build(part)
                self.empty[at].append(a)
                at = b
            self.empty[at].append(last)
        else:
            _, inner, low, high = node
            at = first
            for _ in range(low):
                a, b = self._build(inner)
                self.empty[at].append(a)
                at = b
            if high is None:
                a, b = self._build(inner)
                self.empty[at] += [a, last]
                self.empty[b] += [a, last]
            else:
                for _ in range(high - low):
                    a, b = self._build(inner)
                    self.empty[at] += [a, last]
                    at = b
                self.empty[at].append(last)
        return first, last


@dataclass
class Automaton:
    """next[state * 256 + byte] is the next state; accept[state] has bit k if rule k has just ended.  State 0 is the start."""

    next: np.ndarray
    accept: np.ndarray

    @cached_property
    def lists(self) -> tuple[list[list[int]], list[int]]:
        return self.next.reshape(-1, 256).tolist(), self.accept.tolist()


class Pattern:
    """The deterministic automaton of one pattern from a given place on."""

    def __init__(self, pattern: str, fold: bool) -> None:
        nfa = _Nfa()
        first, last = nfa.add(pattern, fold)
        moves, accept = _subsets(nfa, {last: 0}, first, False)
        self.dead = [k for k, row in enumerate(moves) if not accept[k] and (row == k).all()]
        self.rows, self.accept = moves.tolist(), accept.tolist()
        self.begins = np.array([row not in self.dead for row in self.rows[0]])

    def end(self, data: bytes, at: int) -> int:
        """Where the longest match that begins at a place ends, or -1."""
        state, out, rows, accept, dead = 0, -1, self.rows, self.accept, self.dead
        for k in range(at, len(data)):
            state = rows[state][data[k]]
            if state in dead:
                break
            if accept[state]:
                out = k + 1
        return out


def _subsets(nfa: _Nfa, marks: dict[int, int], start: int, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """The deterministic automaton by subset construction: moves (states x 256), accepted rules as bits; anywhere: matches may begin at every byte."""

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.moves[x] or x in marks)

    begin = closure([start])
    always = begin if anywhere else frozenset()
    number, order, table = {begin: 0}, [begin], []
    for subset in order:
        targets: list[set[int]] = [set() for _ in range(256)]
        for x in subset | always:
            for found, to in nfa.moves[x]:
                for b in found:
                    targets[b].add(to)
        row, known = np.zeros(256, np.int32), {}
        for b, to in enumerate(targets):
            key = frozenset(to)
            if key not in known:
                reached = closure(key) | always
                known[key] = number.setdefault(reached, len(order))
                if known[key] == len(order):
                    order.append(reached)
            row[b] = known[key]
        table.append(row)
    return np.array(table), np.array([sum({1 << marks[x] for x in s if x in marks}) for s in order], np.int64)


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The minimal deterministic automaton that finds an end of a match of any rule anywhere."""
    nfa = _Nfa()
    start, marks = nfa.state(), {}
    for k, rule in enumerate(rules):
        first, last = nfa.add(rule.automaton or rule.pattern, rule.fold)
        nfa.empty[start].append(first)
        marks[last] = k
    moves, accept = _subsets(nfa, marks, start, True)
    block = np.unique(accept, return_inverse=True)[1]
    while True:  # states stay together while all their moves lead to the same blocks
        signature = np.column_stack([block, block[moves]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, some, block = np.unique(block, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(np.where(np.arange(len(some)) == block[0], -1, np.arange(len(some)))))
    small = np.empty((len(some), 256), np.int32)
    small[rank] = rank[block[moves[some]]]
    kept = np.empty(len(some), np.int64)
    kept[rank] = accept[some]
    if small[:, 10].any():
        raise ValueError("the automaton of a rule crosses a line feed")
    return Automaton(small.ravel().astype(np.int32), kept)


FEW = 24  # streams


def _read(machine: Automaton, state: int, data: bytes) -> int:
    """The bits of the rules that accept in the rest of a stream."""
    rows, accept, out = *machine.lists, 0
    for b in data:
        state = rows[state][b]
        if accept[state]:
            out |= accept[state]
    return out


def flags(machine: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document of a chunk the bits of the rules that accept somewhere in it."""
    out = np.zeros(len(offsets) - 1, np.int64)
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.union1d(offsets[:-1], breaks)
    starts = starts[starts < len(data)]
    if not len(starts):
        return out
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # streams longer than t
    state, found = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
    plain = not machine.accept[0]
    for t in range(int(lengths[0])):
        n = alive[t]
        if n <= FEW:  # one lookup a byte costs less than an array operation for so few
            for k in range(n):
                found[k] |= _read(machine, int(state[k]), data[starts[k] + t : starts[k] + lengths[k]].tobytes())
            break
        now = machine.next[(state[:n] << 8) | data[starts[:n] + t]]
        state[:n] = now
        ended = machine.accept[now]
        if not plain or ended.any():
            found[:n] |= ended
    doc = np.searchsorted(offsets, starts, "right") - 1
    np.bitwise_or.at(out, doc, found)
    return out


@lru_cache(maxsize=64)
def _over_lines(rule: Rule) -> re.Pattern:
    return re.compile(rule.pattern, re.ASCII)


@lru_cache(maxsize=64)
def _patterns(rule: Rule) -> tuple[Pattern, Pattern | None]:
    return Pattern(rule.pattern, rule.fold), Pattern(rule.prefix, rule.fold) if rule.prefix else None


def matches(data: bytes, rule: Rule) -> list[tuple[int, int]]:
    """Byte spans of a rule's matches from left to right that are long enough; shorter ones take their place too."""
    whole, prefix = _patterns(rule)
    out, done = [], 0
    for at in np.flatnonzero(whole.begins[np.frombuffer(data, np.uint8)]).tolist():
        if at < done:
            continue
        end = whole.end(data, at)
        if end > 0:
            done = end
            if end - (prefix.end(data, at) if prefix else at) >= rule.least:
                out.append((at, end))
    return out


def spans_of(text: str, rules: tuple[Rule, ...], bits: int) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points of the matches of the flagged rules, in order."""
    out, data = [], text.encode()
    place = None if len(data) == len(text) else np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    for k, rule in enumerate(rules):
        if bits >> k & 1:
            if rule.lines:
                out += [(m.start(), k, m.end()) for m in _over_lines(rule).finditer(text)]
            else:
                out += [(a, k, b) if place is None else (int(place[a]), k, int(place[b])) for a, b in matches(data, rule)]
    return sorted(out)


def _flagged(texts: pa.Array, rules: tuple[Rule, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    machine = compile_rules(rules)
    for row, data, offsets in chunks(texts):
        bits = flags(machine, data, offsets)
        for k in np.flatnonzero(bits):
            yield row + int(k), spans_of(texts[row + int(k)].as_py(), rules, int(bits[k]))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, number of matches of each base kind, the base spans' digest and all spans, for each row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        base = [k for k, rule in enumerate(rules) if rule.base]
        for batch in batches:
            n = batch.num_rows
            counts = {k: np.zeros(n, np.int64) for k in base}
            digest, spans = [none] * n, [""] * n
            for row, found in _flagged(batch.column(1), rules):
                named = [(k, f"{rules[k].kind}:{a}:{b}") for a, k, b in found]
                for k, _ in named:
                    if k in counts:
                        counts[k][row] += 1
                digest[row] = hashlib.sha256(",".join(x for k, x in named if k in counts).encode()).hexdigest()
                spans[row] = ",".join(x for _, x in named)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.values()), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names)

    ids = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{rule.kind}" for rule in rules if rule.base), "base_sha256", "spans"]
    schema = ", ".join([f"doc_id {ids}", *(f"{x} long" for x in names[1:-2]), "base_sha256 string", "spans string"])
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """documents with every span (overlapping ones together) replaced by the mark; all columns stay."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for row, found in _flagged(batch.column(at), rules):
                text, parts, stop = batch.column(at)[row].as_py(), [], 0
                for a, _, b in found:
                    if a >= stop:
                        parts += [text[stop:a], mark]
                    stop = max(stop, b)
                if found:
                    changed[row] = "".join([*parts, text[stop:]])
            if changed:
                values = batch.column(at).to_pylist()
                for row, text in changed.items():
                    values[row] = text
                columns = list(batch.columns)
                columns[at] = pa.array(values, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return documents.mapInArrow(run, documents.schema)
