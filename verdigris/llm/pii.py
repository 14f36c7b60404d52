"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers. The field's tokens are the
entity-like units of a document: spans that the rules found, and other number runs, dotted numbers
and words with an at sign. Words between them can only be outside of any entity, so messages across
them are constant and they need no nodes. Three kinds of factors join the labels (outside or one of
the four kinds):

* a unit's shape (a multinomial regression on discrete features);
* neighbours that stand close to each other;
* skip edges between a unit and the next one that repeats or resembles it (the same digits, with or
  without country code; the same address), however distant.

Factors are trained piecewise on the rules' labels. What they need from the corpus are counts of
feature patterns and label pairs over all documents, a bounded table whatever the input's size.
Inference is loopy sum-product with damping, spans of the rules being evidence. A unit that no rule
found becomes a span if its belief in a kind reaches ``least``; spans of the rules stay.

Defined results: a null or empty text has no spans; very long texts are scanned whole, in linear
time; repeated rows are scanned each; an empty table gives an empty result; further columns pass
through, but for those with the name of a result, which ``detect`` replaces. Without training data the rules alone decide.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.llm.common import map_batches, without

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
Span = tuple[int, int, int]  # kind, start, end

# A match starts at the start of its run of digits or address characters: looking behind spares the
# search every other start, of which none could match first.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++(?P<on>[A-Za-z]?)")
_DOTTED = re.compile(r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++){2,4}(?![0-9A-Za-z])")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            after = found.end()
            out.append((0, start, after))
        else:
            after = max(after, at + 1) if start < at else after
        at = text.find("@", max(at + 1, after))
    return out


def base_spans(text: str) -> list[Span]:
    """The rules' spans by kind, then start: leftmost and non-overlapping within a kind, failing matches dropped."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = digits_of(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


@dataclass
class Unit:
    start: int
    end: int
    label: int  # 0 unless a rule found it
    pattern: tuple
    keys: tuple[str, ...] = ()


def units_of(text: str, base: list[Span]) -> list[Unit]:
    """The entity-like units of a text, in order; those of the rules first where they overlap."""
    if not base and "@" not in text and not _DIGIT.search(text):
        return []
    taken: list[tuple[int, int, int]] = []
    for kind, start, end in sorted(base, key=lambda s: (s[1], -s[2])):
        if not taken or start >= taken[-1][1]:
            taken.append((start, end, kind + 1))
    # a run that a letter follows is none, wherever in it one starts: it is read once
    free = [m.span() for m in _NUMBER.finditer(text) if not m["on"] and m.end() - m.start() >= 7] + [m.span() for m in _DOTTED.finditer(text)] + [(a, b) for a, b in _around_signs(text)]
    free.sort(key=lambda s: (s[0], -s[1]))
    spans, k, upto = [], 0, 0
    for a, b in free:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= upto and (k == len(taken) or b <= taken[k][0]):
            spans.append((a, b, 0))
            upto = b
    return [_unit(text, *s) for s in sorted(taken + spans)]


def _around_signs(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        while b < len(text) and text[b] in _LOCAL:
            b += 1
        if a < at and b > at + 1:
            out.append((a, b))
        at = text.find("@", max(b, at + 1))
    return out


def _unit(text: str, start: int, end: int, label: int) -> Unit:
    said = text[start:end]
    digits = digits_of(said)
    if "@" in said:
        name, _, host = said.lower().partition("@")
        return Unit(start, end, label, ("@", "." in host.strip("."), len(name) > 1), (f"a:{name}@{host.rstrip('.')}", f"n:{name}@{host.split('.')[0]}"))
    n = len(digits)
    dots = said.count(".")
    shape = ("#", n if n < 20 else 20, said[:1] == "+", "(" in said, min(dots, 4), "-" in said, " " in said, n >= 16 and luhn(digits), dots == 3 and all(len(p) <= 3 and int(p or 0) <= 255 for p in said.split(".")))
    keys = (f"d:{digits}", f"t:{digits[-10:]}") if n >= 10 else (f"d:{digits}",)
    return Unit(start, end, label, shape, keys)


def edges_of(units: list[Unit], reach: int = 40) -> list[tuple[int, int, bool]]:
    """(unit, later unit, whether it is a skip edge): close neighbours, and the next unit with the same key."""
    out, last = [], {}
    for k, u in enumerate(units):
        if k and u.start - units[k - 1].end <= reach:
            out.append((k - 1, k, False))
        for key in u.keys:
            if key in last and (last[key], k, True) not in out[-4:]:
                out.append((last[key], k, True))
            last[key] = k
    return out


@dataclass
class Field:
    """Log potentials: of a pattern by label, and of label pairs for near and skip edges."""

    patterns: dict[tuple, np.ndarray] = field(default_factory=dict)
    back_off: np.ndarray = field(default_factory=lambda: np.array([0.0, -3, -3, -3, -3]))
    near: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))

    def unary(self, u: Unit) -> np.ndarray:
        if u.label:  # evidence
            return np.where(np.arange(5) == u.label, 0.0, -30.0)
        return self.patterns.get(u.pattern, self.back_off)


def _fold(x: np.ndarray) -> np.ndarray:
    m = x.max(-1, keepdims=True)
    return x - (m + np.log(np.exp(x - m).sum(-1, keepdims=True)))


def beliefs(units: list[Unit], edges: list[tuple[int, int, bool]], model: Field, rounds: int = 30, damping: float = 0.3) -> np.ndarray:
    """Label marginals of every unit by loopy sum-product, all messages at once."""
    unary = np.array([model.unary(u) for u in units])
    if edges:
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        pair = np.where(np.array([e[2] for e in edges])[:, None, None], model.skip, model.near)
        into_b, into_a = np.zeros((len(edges), 5)), np.zeros((len(edges), 5))
        for _ in range(rounds):
            total = unary.copy()
            np.add.at(total, b, into_b)
            np.add.at(total, a, into_a)
            x = (total[a] - into_a)[:, :, None] + pair
            y = (total[b] - into_b)[:, None, :] + pair
            new_b = _fold(np.logaddexp.reduce(x, axis=1))
            new_a = _fold(np.logaddexp.reduce(y, axis=2))
            change = max(np.abs(new_b - into_b).max(), np.abs(new_a - into_a).max())
            into_b, into_a = damping * into_b + (1 - damping) * new_b, damping * into_a + (1 - damping) * new_a
            if change < 1e-4:
                break
        np.add.at(unary, b, into_b)
        np.add.at(unary, a, into_a)
    return np.exp(_fold(unary))


def find(text: str | None, model: Field, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """The rules' spans, and all spans by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    units = units_of(text, base)
    if all(u.label for u in units):
        return base, base
    p = beliefs(units, edges_of(units), model)
    more = [(int(k) - 1, u.start, u.end) for u, k, row in zip(units, p.argmax(1), p, strict=True) if not u.label and k and row[k] >= least]
    return base, sorted(base + more)


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """Counts patterns and label pairs over all documents and fits the factors to them."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(text_col).to_pylist():
                units = units_of(text, base_spans(text)) if text else []
                for u in units:
                    seen["u", repr(u.pattern), u.label, 0] += 1
                for a, b, skip in edges_of(units):
                    seen["s" if skip else "n", "", units[a].label, units[b].label] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip([*zip(*seen, strict=True), seen.values()], (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["what", "pattern", "a", "b", "n"])

    sums = map_batches(docs.select(text_col), count, "what string, pattern string, a bigint, b bigint, n bigint").groupBy("what", "pattern", "a", "b").agg(F.sum("n").alias("n")).collect()
    return fitted([tuple(r) for r in sums])


def fitted(sums: list[tuple[str, str, int, int, int]]) -> Field:
    import ast

    model = Field()
    table: dict[tuple, np.ndarray] = {}
    for what, pattern, a, b, n in sums:
        if what == "u":
            table.setdefault(ast.literal_eval(pattern), np.zeros(5))[a] += n
        else:
            (model.skip if what == "s" else model.near)[a, b] += n
    if not table:
        return Field()
    # regression on the parts of a pattern, so that rare patterns lean on common parts
    names: dict[tuple, int] = {}
    rows = [[names.setdefault((p[0], k, v), len(names)) for k, v in enumerate(p)] for p in table]
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        x[k, r] = 1
    y = np.array(list(table.values()))
    y = y / y.sum() * 1000
    w = np.zeros((len(names), 5))
    step = 0.02
    for _ in range(400):
        p = np.exp(_fold(x @ w))
        w -= step * (x.T @ (p * y.sum(1, keepdims=True) - y) + 0.05 * w)
    model.patterns = {p: np.clip(_fold(row), -6, 0) for p, row in zip(table, x @ w, strict=True)}
    model.back_off = np.clip(_fold(np.log(y.sum(0) + 1.0)), -6, 0)
    # pair factors: pointwise mutual information, so that they leave the labels' shares alone
    for name, most in (("near", 1.0), ("skip", 8.0)):
        # the prior is worth 20 pairs: near ones are independent, 98 of 100 repeats keep their label
        prior = np.full((5, 5), 0.04) if name == "near" else np.full((5, 5), 0.001) + np.eye(5) * 0.195
        n = getattr(model, name) + getattr(model, name).T + 20 * prior
        share = n.sum(1) / n.sum()
        setattr(model, name, np.clip(np.log(n / n.sum() / np.outer(share, share)), -most, most))
    return model


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of every span; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > at:
            if a >= at:
                out.append(f"{text[at:a]}<{KINDS[kind].upper()}>")
            at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: Field, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """The documents with n_email, n_ip, n_card, n_phone (rules), base_sha256 and spans."""
    docs = without(docs, *(f"n_{k}" for k in KINDS), "base_sha256", "spans")

    def work(batches):
        for batch in batches:
            told = [find(x, model, least) for x in batch.column(text_col).to_pylist()]
            more = [pa.array([sum(s[0] == k for s in base) for base, _ in told], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in told], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, digest, pa.array([spans_text(s) for _, s in told], pa.string())], [*batch.schema.names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    more = T._parse_datatype_string("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string").fields
    return map_batches(docs, work, T.StructType([*docs.schema.fields, *more]))


def redact(docs: DataFrame, model: Field, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """The documents with every span replaced in their text; null texts stay null."""

    def work(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [x and redacted(x, find(x, model, least)[1]) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, work, docs.schema)
