"""Secret scans: assignment-aware lexing of source and configuration text.

Three base kinds are plain patterns (``assign``, ``access``, ``hex``). The lexer adds kind
``lexed``: it reads name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``,
``name := 'x'``, ``name => x``, ``export NAME=x``, ``d["name"] = "x"``, ``name: str = "x"``), propagates constants through names,
``${NAME}`` references and ``+`` concatenation in the order of the text, and scores every literal
by how sensitive its target name is and by how much the literal looks like a random value. A
literal that scores ``threshold`` or more becomes a span where it stands, even if the sensitive
name takes it from an innocent constant.

Spans count code points, end exclusive. Time is linear in a text's length, for any text (times the
distinct characters of values that ``+`` joins), and a value is scored whole, by how often it has each
character, so constants that double constants are never spelled out. Defined cases: a null text counts as empty, no span
gives the empty string, a text of any length is read whole, alone in its slice; spans with the same
start go in the order of the kinds, then by end; of two assignments to a name the last one before a
use counts; repeated rows give repeated results, an empty table gives an empty result; only the two
named input columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

KINDS = ("assign", "access", "hex", "lexed")

# Patterns of the base kinds. ASCII: the Kelvin sign and the long s aren't letters of a keyword.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # maximal runs, so the same as dropping the short ones

# Lexer tokens: a name, its operator, and the terms joined by + on the right. A name is read once, from
# the start of its run of characters. A closing quote and bracket may follow it (a subscript), or a
# type before the operator of a quoted literal (an annotation).
_PAIR = re.compile(r"""(?<![A-Za-z0-9_.-])[0-9.-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)["']?\]?[ \t]*+(?::[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n]{0,64}\])?[ \t]*+=(?=[ \t]*+[rbuf]?["'])|:=|=>|=(?!=)|:(?!//))[ \t]*+""")
_TERM = re.compile(r"""(?:[rbuf]?"(?P<double>[^"\n\\]*(?:\\.[^"\n\\]*)*)"|[rbuf]?'(?P<single>[^'\n\\]*(?:\\.[^'\n\\]*)*)'|\$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_]*)\}?|(?P<bare>[A-Za-z0-9+/_.=-]+))""")
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+(?=[\"'$A-Za-z_])")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: How much a part of a name says that its value is secret.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.6, "salt": 0.6}
#: Parts that make "key" sensitive.
KEY_OWNERS = {"api", "access", "private", "secret", "encryption", "signing", "master", "aws", "auth", "client"}
#: Bits of a count: of joined values of more than 2**256 characters only the proportions are kept.
COUNT_BITS = 256
PLACEHOLDERS = {"changeme", "example", "none", "null", "true", "false", "undefined", "todo", "xxxxxx", "password", "secret", "token"}


def sensitivity(name: str) -> float:
    """0 to 1, from the parts of a snake, kebab, dotted or camel case name."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts and KEY_OWNERS & set(parts) or "apikey" in "".join(parts):
        score = 1.0
    return score


def randomness_of(counts: dict[str, int], n: int, said: str | None = None) -> float:
    """``randomness`` of a value of ``n`` characters by its counts; short ones need the text too."""
    if n < 6 or said is not None and said.lower() in PLACEHOLDERS or len(counts) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    seen = "".join(counts)
    kinds = sum(bool(re.search(p, seen)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * min(entropy, 4) * (0.6 + 0.2 * kinds))


def randomness(value: str) -> float:
    """0 to 1: short values and placeholders 0, else by entropy a character and kinds of character."""
    return randomness_of(Counter(value), len(value), value)


_LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))


class _Value:
    """A literal with its place, or what joins some, by its parts and counts. Parts are shared and
    not copied, and the text of a joined value is kept only as long as it may be a placeholder."""

    __slots__ = ("counts", "n", "parts", "place", "said")

    def __init__(self, said: str | None, place: tuple[int, int] | None = None, parts: list[_Value] | None = None):
        self.said, self.place, self.parts, self.counts = said, place, parts or (), None
        if parts is None:
            self.n = len(said)
            return
        self.n, self.counts = sum(p.n for p in parts), {}
        if self.n <= _LONGEST_PLACEHOLDER:
            self.said = "".join(p.said for p in parts)
        for p in parts:
            for c, k in p.counted().items():
                self.counts[c] = self.counts.get(c, 0) + k
        if (more := self.n.bit_length() - COUNT_BITS) > 0:
            self.counts = {c: max(1, k >> more) for c, k in self.counts.items()}
            self.n = sum(self.counts.values())

    def counted(self) -> dict[str, int]:
        return Counter(self.said) if self.counts is None else self.counts

    def randomness(self) -> float:
        return randomness_of(self.counted(), self.n, self.said)


def lexed_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Places of literals that reach a sensitive name, by lexing ``text`` once from left to right."""
    constants: dict[str, _Value] = {}
    marked: dict[int, _Value] = {}
    at = 0
    while pair := _PAIR.search(text, at):
        at, terms = pair.end(), []
        while term := _TERM.match(text, at):
            body = term.lastgroup
            said = term[body]
            if body == "ref" or body == "bare" and _IDENTIFIER.match(said) and said in constants:
                terms += [constants[said]] if said in constants else []
            else:
                terms.append(_Value(said, term.span(body)))
            at = term.end()
            if not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if not terms:
            continue
        name = pair["name"]
        value = terms[0] if len(terms) == 1 else _Value(None, None, terms)
        constants[name] = value
        if (weight := sensitivity(name)) and weight * value.randomness() >= threshold:
            reached = [value]
            while reached:
                part = reached.pop()
                if id(part) not in marked:
                    marked[id(part)] = part
                    reached += part.parts
        # a value may itself be the name of the next pair, as in "a: b: c"
        if text[at : at + 1] in (":", "=") and value.place == (pair.end(), at) and _NAME.match(text[pair.end() : at]):
            at = pair.end()
    return sorted({v.place for v in marked.values() if v.place and v.place[0] < v.place[1]})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in the order of the contract."""
    spans = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    if "=" in text or ":" in text:
        spans += [(a, 3, b) for a, b in lexed_spans(text, threshold)]
    return sorted(spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a text: ``spans``, an array of (kind, start, end) ordered by start and kind."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t or "", threshold)] for t in batch.column(1).to_pylist()]
            return {"id": batch.column(0), "spans": pa.array(spans, pa.list_(_SPAN))}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_slices(picked, "text", make, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact_column(df: DataFrame, text_col: str = "text", length_col: str | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with the secrets in ``text_col`` replaced, and ``length_col`` set to the new length of
    the texts that changed; a null stays null, other texts and columns pass as they are."""
    at, long_at = df.columns.index(text_col), df.columns.index(length_col) if length_col else None

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns, old = list(batch.columns), batch.column(at).to_pylist()
            new = [t if not t or not (spans := all_spans(t, threshold)) else redacted(t, spans, mark) for t in old]
            columns[at] = pa.array(new, pa.string())
            if long_at is not None:
                lengths = columns[long_at].to_pylist()
                columns[long_at] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(lengths, old, new, strict=True)], columns[long_at].type)
            return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return step

    return map_slices(df, text_col, make, df.schema)


def secret_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``secret_spans``: counts and joined spans."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return secret_spans(df, id_col, text_col).select(id_col, *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
