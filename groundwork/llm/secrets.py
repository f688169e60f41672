"""Secret scans: fixed patterns, and an assignment-aware lexer that follows constants."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns of the contract and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more: shorter runs are dropped anyway
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "literal")

#: Weight of a part of a target name.
SENSITIVE = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "secret": 4, "token": 3, "apikey": 4, "credential": 4, "credentials": 4,
    "private": 2, "api": 1, "key": 2, "auth": 2, "access": 1, "bearer": 3, "signing": 2, "encryption": 2, "client": 1, "session": 1, "webhook": 1, "dsn": 2,
}
#: Parts that make a name harmless, and values that are placeholders.
HARMLESS = {"error", "message", "prompt", "hint", "help", "description", "title", "placeholder", "count", "counts", "max", "min", "length", "len", "limit", "url", "file", "path", "name", "type", "id", "field", "label", "public", "expires", "timeout", "ttl", "size"}
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "todo", "redacted", "placeholder", "undefined", "your_password", "your_api_key", "your_token"}

#: Names whose value belongs to what stands around them, and names whose value is a name.
CARRIERS = {"value", "default", "data", "content", "val", "raw", "current", "text"}
LABELS = {"key", "name", "id", "field", "setting", "property"}
_JOINERS = {"or", "and", "if", "else"}
_EXPORTS = {"export", "set", "env", "ENV", "declare"}
_CLOSERS = {")": "(", "]": "[", "}": "{"}

_LEXER = re.compile(
    r"""(?P<triple>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')
      | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
      | (?P<number>[0-9][A-Za-z0-9_.+/=-]*)
      | (?P<op>:=|=>|==|!=|<=|>=|->|\|\||\?\?|[=:+,;{}()\[\]&])
      | (?P<line>\n)""",
    re.VERBOSE | re.DOTALL,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@%^*-]+")
_NOT_IN_PARTS = bytes(c for c in range(128) if not chr(c).isalnum())
_NAME = re.compile(r"[A-Za-z_][\w.-]*")
_WORDS_ONLY = re.compile(r"[A-Z][A-Z0-9_]*|[A-Za-z_.:/ -]*")
_PATH = re.compile(r"[A-Za-z_]+(?:\.[A-Za-z_]+)+")
_GAP = re.compile(r"[ \t]*")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _may_name(text: str) -> bool:
    """Whether a name in the text can have a weight: a plain search for what name_weight finds."""
    low = text.lower()
    if any(word in low for word in SENSITIVE):
        return True
    joined = text.encode("ascii", "ignore").translate(None, _NOT_IN_PARTS).lower().decode()
    return any(word in joined for word in SENSITIVE if len(word) > 5)


def name_weight(name: str) -> int:
    """Sum of the weights of a name's parts (camel case, underscores, dots, dashes)."""
    parts = [p.lower() for p in _SPLIT.findall(name)]
    joined = "".join(parts)
    if any(p in HARMLESS for p in parts[-1:]):
        return 0
    return max([sum(SENSITIVE.get(p, 0) for p in parts), *[w for k, w in SENSITIVE.items() if len(k) > 5 and k in joined]])


def value_weight(value: str, phrase: bool = False) -> float:
    """How much a literal looks like a secret: length, alphabet and entropy; 0 for
    placeholders, and for texts with blanks unless a ``phrase`` may be a secret here."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or value.startswith(("${", "<", "{{", "http://", "https://")):
        return 0.0
    if not phrase and " " in value.strip():
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(map(f, value)) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return bits / 4 + (kinds - 1) / 2 + (len(value) >= 16) / 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches per kind that are long enough: start, end, kind."""
    low, out = text.lower(), []
    if any(word in low for word in _NAMES):  # a plain search first: most texts have none
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


@dataclass(eq=False)
class Binding:
    """A name with the literals bound to it, as (value, start, end, whether inside a call or
    subscript), and the earlier bindings that its right side names."""

    name: str
    line: int
    literals: list[tuple[str, int, int, bool]] = field(default_factory=list)
    sources: list[Binding] = field(default_factory=list)

    def filled(self) -> bool:
        return bool(self.literals or self.sources)


@dataclass(eq=False)
class _Frame:
    """What an open bracket holds: the binding around it, the one being read inside it, and
    the last literal of a label such as ``name``."""

    opener: str = ""
    around: Binding | None = None
    called: bool = False
    own: Binding | None = None
    own_name: str = ""
    by: str = ""
    bare: bool = False
    join: bool = False
    label: tuple[str, int] | None = None


class _Reader:
    """Reads bindings from the tokens of one text. The time is linear in the text."""

    def __init__(self, text: str):
        self.text, self.out, self.latest = text, [], {}
        self.frames, self.parents = [_Frame()], []
        self.line, self.line_start, self.in_line = 0, 0, 0
        self.pending, self.pending_first, self.pending_column, self.taken = None, False, 0, None
        self.word, self.word_end = "", -1

    def read(self) -> list[Binding]:
        at = 0
        while m := _LEXER.search(self.text, at):
            at = m.end()
            kind, value = m.lastgroup, m[0]
            if kind == "line":
                self._line(m)
                continue
            self.in_line += 1
            if kind in ("text", "triple"):
                quote = 3 if kind == "triple" else 1
                self._literal(value[quote:-quote], m.start() + quote, m.end() - quote)
                self._pend(value[quote:-quote], m.start())
                self.line += value.count("\n")
            elif kind in ("name", "number"):
                at = max(at, self._word(kind, value, m.start()))
            else:
                at = max(at, self._operator(value, m))
                self.pending = self.taken = None
        while self.frames:
            self._close()
            self.frames.pop()
        return self.out

    def _pend(self, name: str, start: int) -> None:
        known = len(name) <= 200 and _NAME.fullmatch(name)
        first = self.in_line == 1 or (self.in_line == 2 and self.word in _EXPORTS)
        self.pending, self.pending_first, self.pending_column = name if known else None, first, start - self.line_start

    def _close(self) -> None:
        top = self.frames[-1]
        if top.own is not None:
            if top.own.filled():
                self.latest[top.own_name] = top.own
            if top.own_name.lower() in LABELS and len(top.own.literals) == 1 and _NAME.fullmatch(top.own.literals[0][0][:200]):
                top.label = (top.own.literals[0][0], self.line)
        top.own, top.join = None, False

    def _holder(self) -> Binding | None:
        """The binding that the next literal or name belongs to."""
        top = self.frames[-1]
        if top.own is not None and top.own.filled() and not top.join:
            self._close()
            return None
        return top.own or top.around

    def _literal(self, value: str, start: int, end: int, bare: bool = False) -> None:
        holder, top = self._holder(), self.frames[-1]
        self.taken = None
        if holder is not None:
            holder.literals.append((value, start, end, top.called))
            top.join, top.bare, self.taken = False, bare, holder.literals

    def _word(self, kind: str, value: str, start: int) -> int:
        top, end = self.frames[-1], start + len(value)
        self.taken = None
        if value in _JOINERS and top.own is not None:
            top.join, self.pending, self.word, self.word_end = top.own.filled(), None, value, end
            return end
        holder = top.around if top.own is None else top.own if not top.own.filled() or top.join else None
        if holder is not None and value in self.latest:
            holder.sources.append(self.latest[value])
            top.join, self.taken = False, holder.sources
        elif top.own is not None and not top.own.filled() and (bare := self._bare(start, False)):
            self._literal(*bare, True)
            self.pending = self.taken = None
            return bare[2]
        self._pend(value if kind == "name" else "", start)
        self.word, self.word_end = value, end
        return end

    def _bare(self, at: int, plain: bool) -> tuple[str, int, int] | None:
        """A value without quotes: one with a digit, or any one if ``plain``."""
        m = _BARE.match(self.text, at)
        if not m or m.end() - at < 6 or m[0] in self.latest or self.text[m.end() : m.end() + 1] in ("(", "[", "{", '"', "'"):
            return None
        ends = self.text[m.end() : m.end() + 1] in ("", " ", "\t", "\r", "\n", ";", "#")
        if any(map(str.isdigit, m[0])) or (plain and ends and not _PATH.fullmatch(m[0])):
            return m[0], m.start(), m.end()
        return None

    def _line(self, m: re.Match) -> None:
        if self.in_line == 0 and not self.text[self.line_start : m.start()].strip():  # a blank line
            while len(self.frames) > 1:
                self._close()
                self.frames.pop()
            self._close()
            self.parents = []
        top = self.frames[-1]
        if len(self.frames) == 1 and top.own is not None and top.own.filled() and not top.join:
            self._close()
        self.line, self.line_start, self.in_line = self.line + 1, m.end(), 0
        self.pending = self.taken = None

    def _operator(self, value: str, m: re.Match) -> int:
        top = self.frames[-1]
        if value in ("=", ":=", ":", "=>"):
            return self._bind(value, m)
        if value in ("+", "||", "??"):
            top.join = top.own is not None and top.own.filled()
        elif value in ("(", "[", "{"):
            called = top.called or (value != "{" and self.word_end == m.start())
            around = None if top.own is not None and top.own.filled() and not top.join else top.own or top.around
            self.frames.append(_Frame(value, around, called))
        elif value in _CLOSERS:
            if len(self.frames) > 1 and top.opener == _CLOSERS[value]:
                self._close()
                self.frames.pop()
                self.word_end = m.end()
        else:
            self._close()
            if value == ";":
                top.around = None  # statements of a block, not elements of a value
        return m.end()

    def _bind(self, op: str, m: re.Match) -> int:
        top = self.frames[-1]
        if self.taken:
            self.taken.pop()  # what looked like a value is a key
        typed = op == "=" and top.own is not None and top.by == ":" and top.own.line == self.line
        if typed and (not top.own.filled() or (top.bare and self.pending is None and len(top.own.literals) == 1)):
            top.own.literals.clear()
            top.by, depth = "=", len(self.frames)
            return self._value(op, m, depth == 1 and self.pending_first)
        if self.pending is None:
            if op == "=>":
                self._close()
            return m.end()
        name, column, first = self.pending, self.pending_column, self.pending_first
        self._close()
        parent = top.around.name if top.around is not None else None
        if len(self.frames) == 1 and first and op == ":":
            while self.parents and self.parents[-1][0] >= column:
                self.parents.pop()
            parent = self.parents[-1][1] if self.parents else None
        full = name
        if name.lower() in CARRIERS:
            near = top.label is not None and (len(self.frames) > 1 or self.line - top.label[1] <= 1)
            full = top.label[0] if near else parent or name
        if len(self.frames) == 1 and first and op == ":":
            self.parents.append((column, full))
        top.own, top.own_name, top.by, top.bare = Binding(full, self.line), name, op, False
        self.out.append(top.own)
        return self._value(op, m, first and op == "=" and len(self.frames) == 1)

    def _value(self, op: str, m: re.Match, plain: bool) -> int:
        """Takes a value without quotes right after the operator, if there is one."""
        at = _GAP.match(self.text, m.end()).end()
        if bare := self._bare(at, plain and at == m.end()):
            self._literal(*bare, True)
            self.word_end = -1
            return bare[2]
        top = self.frames[-1]
        if top.own_name.lower() in LABELS and (name := _NAME.match(self.text, at)):
            top.label = (name[0], self.line)
        return m.end()


def bindings(text: str) -> list[Binding]:
    """Names with what is bound to them, in source and configuration syntax.

    Understood are ``name = "literal"`` with ``:=``, ``:`` (mappings, also with a quoted
    key), ``=>`` and typed declarations, call arguments, sums and alternatives of literals,
    and literals inside the brackets, calls and subscripts of a value. Shell, property and
    YAML lines may have a bare value: any one right after a ``=``, else one with a digit. The
    value of ``value``, ``default`` and the like belongs to the name beside it (``name:
    DB_PWD``, ``key="DbPwd"``) or to the mapping around it. A name on the right stands for
    what was bound to it last, so constants are followed through any number of copies. A
    blank line ends whatever is open. Comments are read like code.
    """
    if ("=" not in text and ":" not in text) or not _may_name(text):
        return []  # no name here could be sensitive
    return _Reader(text).read()


def _reached(binding: Binding, done: set[int]) -> Iterator[tuple[str, int, int, bool]]:
    """The literals of a binding and of all it names, each binding once per ``done``."""
    stack = [binding]
    while stack:
        node = stack.pop()
        if id(node) not in done:
            done.add(id(node))
            yield from node.literals
            stack += node.sources


def assignments(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Name-literal pairs of a text: name, value, start and end of the literal."""
    for binding in bindings(text):
        for value, a, b, _ in _reached(binding, set()):
            yield binding.name, value, a, b


def literal_spans(text: str, least: float = 4.0) -> list[tuple[int, int, str]]:
    """Literals bound to a sensitive name, scored by the name times the value. A literal that
    was bound under a harmless name is found when it is copied to a sensitive one. Texts
    with blanks count for the most telling names only; inside a call or a subscript neither
    they nor mere words count, since those are prompts and keys."""
    found, done = set(), {}
    for binding in bindings(text):
        if weight := name_weight(binding.name):
            for value, a, b, called in _reached(binding, done.setdefault(weight, set())):
                if b > a and not (called and _WORDS_ONLY.fullmatch(value)) and weight * value_weight(value, weight >= 4 and not called) >= least:
                    found.add((a, b))
    return [(a, b, "literal") for a, b in sorted(found)]


def scan(text: str | None, least: float = 4.0) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans, by start, kind and end. A literal that a base span of the
    same text already covers is not reported again."""
    text = text or ""
    key = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(base_spans(text), key=key)
    starts, ends = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
    covered = lambda a, b: (n := bisect_right(starts, a)) > 0 and ends[n - 1] >= b
    return base, sorted(base + [s for s in literal_spans(text, least) if not covered(s[0], s[1])], key=key)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, least: float = 4.0) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start, then
    kind. The counts and the digest are those of the base patterns; ``spans`` has the
    literals of the lexer besides. A null text is empty. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, every = scan(text, least)
                n = Counter(s[2] for s in every)
                counts.append([n[k] for k in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            columns = [batch.column("doc_id"), *numbers[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), numbers[3]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
