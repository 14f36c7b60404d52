"""A compiler for a small, sandboxed template language.

Source is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
write pieces of output. Templates see only the values they are given: dictionaries, lists, strings,
numbers, booleans and none. There are no calls, no attributes of Python objects, no imports and no
unbounded loops, so a template can neither reach the process nor run for ever.

    {{ expression }}                                    output
    {% for x in xs %} ... {% endfor %}                  loop.index, index0, first, last inside
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set x = expression %}
    {% generation %} ... {% endgeneration %}            output that a model is to learn
    {# comment #}, and a minus at a tag's edge strips white space beside it

Expressions have literals, names, x.key and x['key'], filters (escape, trim, upper, lower, length),
+ - * // % ~, comparisons, in, not, and, or, and a if b else c. A list that is looped over may be any
iterator; it is read one element ahead, so output can be longer than memory. Such a stream is there
once: a template that loops over it again, measures, tests, compares or indexes it gets a TemplateError.
A text that an expression makes has LONGEST_TEXT characters at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>()\[\].|]))", re.S)
_POWER = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "in": 4, "not in": 4, "+": 5, "-": 5, "~": 5, "*": 6, "//": 6, "%": 6}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
#: Products of strings and large powers would let a short template fill memory.
_LARGEST = 1 << 63
LONGEST_TEXT = 1 << 26

ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_ESCAPED = str.maketrans(ESCAPES)
_BACK = {v: k for k, v in ESCAPES.items()}


class TemplateError(ValueError):
    """A template that can't be parsed, or a value that it can't use."""


def escape(text: str) -> str:
    """The text without angle brackets, of which every control string has one."""
    return text.translate(_ESCAPED)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lg]", lambda m: _BACK[m[0]], text) if "\\" in text else text


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    what: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


class Stream:
    """A list that can be looped over once, and nothing else."""

    def __init__(self, items: Iterable):
        self._items: Iterator | None = iter(items)

    def __iter__(self) -> Iterator:
        items, self._items = self._items, None
        if items is None:
            raise TemplateError("a stream of messages can be looped over once")
        return items

    def _refuse(self, *_: object) -> bool:
        raise TemplateError("a stream of messages can only be looped over")

    __bool__ = __eq__ = __contains__ = __len__ = __str__ = __getitem__ = _refuse
    __hash__ = None


def _whole(x: object) -> object:
    if isinstance(x, Stream):
        x._refuse()
    return x


def _joined(a: str, b: str) -> str:
    if len(a) + len(b) > LONGEST_TEXT:
        raise TemplateError("a text is too long")
    return a + b


def _text(x: object) -> str:
    return "" if x is None else str(x)


def _number(x: object) -> int:
    if isinstance(x, bool) or not isinstance(x, int):
        raise TemplateError(f"{x!r} is not a number")
    return x


def _small(x: int) -> int:
    if abs(x) > _LARGEST:
        raise TemplateError("a number is too large")
    return x


def _get(of: object, key: object) -> object:
    _whole(of)
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _plus(a: object, b: object) -> object:
    return _joined(a, b) if isinstance(a, str) and isinstance(b, str) else _small(_number(a) + _number(b))


def _within(a: object, b: object) -> bool:
    _whole(b)
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return isinstance(b, (Mapping, list, tuple)) and a in b


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": _within,
    "not in": lambda a, b: not _within(a, b),
    "+": _plus,
    "-": lambda a, b: _small(_number(a) - _number(b)),
    "*": lambda a, b: _small(_number(a) * _number(b)),
    "//": lambda a, b: _number(a) // _number(b),
    "%": lambda a, b: _number(a) % _number(b),
    "~": lambda a, b: _joined(_text(a), _text(b)),
}
_UNARY: dict[str, Callable] = {
    "not": lambda a: not a,
    "neg": lambda a: -_number(a),
    "|escape": lambda a: escape(_text(a)),
    "|trim": lambda a: _text(a).strip(),
    "|upper": lambda a: _text(a).upper(),
    "|lower": lambda a: _text(a).lower(),
    "|length": lambda a: len(a) if _whole(a) is not None and isinstance(a, (str, list, tuple, Mapping)) else 0,
}


class _Expression:
    """Precedence climbing over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            at = m.end()
            kind = m.lastindex
            self.tokens.append((kind, re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), m[2][1:-1], flags=re.S) if kind == 2 else m[kind]))
        self.at = 0

    def peek(self) -> tuple[int, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (0, "")

    def take(self, sign: str | None = None) -> str:
        kind, said = self.peek()
        if not kind or sign is not None and (kind == 2 or said != sign):
            raise TemplateError(f"{sign or 'a value'} expected before {said!r}")
        self.at += 1
        return said

    def sign(self) -> str:
        kind, said = self.peek()
        if kind == 3 and said == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == (3, "in"):
            return "not in"
        return said if kind in (3, 4) else ""

    def whole(self) -> object:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.peek()[1]!r} is left over")
        return out

    def choice(self) -> object:
        then = self.binary(0)
        if self.sign() != "if":
            return then
        self.take("if")
        test = self.binary(0)
        if self.sign() == "else":
            self.take("else")
            return Op("?", (test, then, self.choice()))
        return Op("?", (test, then, Const(None)))

    def binary(self, least: int) -> object:
        if self.sign() == "not":
            self.take()
            left = Op("not", (self.binary(3),))
        elif self.sign() == "-":
            self.take()
            left = Op("neg", (self.binary(7),))
        else:
            left = self.operand()
        while (power := _POWER.get(sign := self.sign(), 0)) > least:
            self.take()
            if sign == "not in":
                self.take("in")
            left = Op(sign, (left, self.binary(power)))
        return left

    def operand(self) -> object:
        kind, said = self.peek()
        self.take()
        if kind == 1:
            out: object = Const(_small(int(said[:20])))
        elif kind == 2:
            out = Const(said)
        elif kind == 3:
            out = Const(_WORDS[said]) if said in _WORDS else Name(said)
        elif said == "(":
            out = self.choice()
            self.take(")")
        else:
            raise TemplateError(f"{said!r} is not a value")
        while (sign := self.sign()) in (".", "[", "|"):
            self.take()
            if sign == ".":
                out = Get(out, Const(self.take()))
            elif sign == "[":
                out = Get(out, self.choice())
                self.take("]")
            else:
                name = "|" + self.take()
                if name not in _UNARY:
                    raise TemplateError(f"no filter {name[1:]!r}")
                out = Op(name, (out,))
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = _TAG.split(source)
    for k in range(1, len(parts), 2):
        if not parts[k].startswith("{#"):
            if parts[k][2] == "-":
                parts[k - 1] = parts[k - 1].rstrip()
            if parts[k][-3] == "-":
                parts[k + 1] = parts[k + 1].lstrip()
    tags = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if part:
                tags.append(("text", part))
        elif part.startswith("{{"):
            tags.append(("show", part[2:-2].strip("-")))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip("-").strip().partition(" ")
            tags.append((word, rest.strip()))
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(tags):
            word, rest = tags[at]
            at += 1
            if word in ends:
                return tuple(out), word, rest
            if word == "text":
                out.append(Text(rest))
            elif word == "show":
                out.append(Show(_Expression(rest).whole()))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read for {rest}")
                body, _, _ = block("endfor")
                out.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "if":
                out.append(branch(rest))
            elif word == "set":
                name, sign, value = rest.partition("=")
                if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"can't read set {rest}")
                out.append(Assign(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                out.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return tuple(out), "", ""

    def branch(test: str) -> If:
        then, word, rest = block("elif", "else", "endif")
        if word == "elif":
            return If(_Expression(test).whole(), then, (branch(rest),))
        return If(_Expression(test).whole(), then, block("endif")[0] if word == "else" else ())

    return block()[0]


def fold(node: object) -> object:
    """The node with constant expressions worked out, dead branches dropped and texts joined."""
    match node:
        case tuple():
            out: list = []
            for x in node:
                f = fold(x)
                for y in f if isinstance(f, tuple) else (f,):
                    if isinstance(y, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].text + y.text)
                    elif not (isinstance(y, Text) and not y.text):
                        out.append(y)
            return tuple(out)
        case Get(of, key):
            of, key = fold(of), fold(key)
            return Const(_get(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Get(of, key)
        case Op(sign, args):
            args = tuple(fold(a) for a in args)
            first = args[0]
            if sign == "?" and isinstance(first, Const):
                return args[1] if first.value else args[2]
            if sign in ("and", "or") and isinstance(first, Const):
                return args[1] if bool(first.value) == (sign == "and") else first
            if sign not in ("?", "and", "or") and all(isinstance(a, Const) for a in args):
                try:
                    return Const((_UNARY if len(args) == 1 else _BINARY)[sign](*(a.value for a in args)))
                except (TemplateError, TypeError, ZeroDivisionError):
                    pass  # an error that the run may never come to
            return Op(sign, args)
        case Show(what):
            what = fold(what)
            return Text(_text(what.value)) if isinstance(what, Const) else Show(what)
        case If(test, then, other):
            test = fold(test)
            if isinstance(test, Const):
                return fold(then if test.value else other)
            return If(test, fold(then), fold(other))
        case For(name, over, body):
            return For(name, fold(over), fold(body))
        case Assign(name, value):
            return Assign(name, fold(value))
        case Generation(body):
            return Generation(fold(body))
    return node


def _value(node: object) -> Callable[[dict], object]:
    match node:
        case Const(value):
            return lambda env: value
        case Name(name):
            return lambda env: env.get(name)
        case Get(of, key):
            a, b = _value(of), _value(key)
            return lambda env: _get(a(env), b(env))
        case Op("?", (test, then, other)):
            t, a, b = _value(test), _value(then), _value(other)
            return lambda env: a(env) if t(env) else b(env)
        case Op("and", (x, y)):
            a, b = _value(x), _value(y)
            return lambda env: a(env) and b(env)
        case Op("or", (x, y)):
            a, b = _value(x), _value(y)
            return lambda env: a(env) or b(env)
        case Op(sign, (x,)):
            a, one = _value(x), _UNARY[sign]
            return lambda env: one(a(env))
        case Op(sign, (x, y)):
            a, b, two = _value(x), _value(y), _BINARY[sign]

            def run(env):
                try:
                    return two(a(env), b(env))
                except (TypeError, ZeroDivisionError) as e:
                    raise TemplateError(str(e)) from e

            return run
    raise TemplateError(f"can't compile {node!r}")


class Sink:
    """Where output goes: pieces, and whether the model is to learn them."""

    def write(self, piece: str, learned: bool) -> None:
        raise NotImplementedError


Run = Callable[[dict, Sink, bool], None]


def _run(nodes: tuple) -> Run:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env, sink, learned):
        for s in steps:
            s(env, sink, learned)

    return run


def _turns(node: For, body: Run, over: Iterable | None, env: dict, sink: Sink, learned: bool) -> Iterator[None]:
    rest, end = iter(over if isinstance(over, Stream) else over or ()), object()
    now, k = next(rest, end), 0
    while now is not end:
        then = next(rest, end)
        body(env | {node.name: now, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": then is end}}, sink, learned)
        yield
        now, k = then, k + 1


def _step(node: object) -> Run:
    match node:
        case Text(text):
            return lambda env, sink, learned: sink.write(text, learned)
        case Show(what):
            value = _value(what)
            return lambda env, sink, learned: sink.write(_text(value(env)), learned)
        case Assign(name, value):
            value = _value(value)
            return lambda env, sink, learned: env.__setitem__(name, value(env))
        case Generation(body):
            inner = _run(body)
            return lambda env, sink, learned: inner(env, sink, True)
        case If(test, then, other):
            t, a, b = _value(test), _run(then), _run(other)
            return lambda env, sink, learned: (a if t(env) else b)(env, sink, learned)
        case For(_, over, body):
            xs, inner = _value(over), _run(body)

            def loop(env, sink, learned):
                for _ in _turns(node, inner, xs(env), env, sink, learned):
                    pass

            return loop
    raise TemplateError(f"can't compile {node!r}")


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._nodes = [(n, _step(n)) for n in self.tree]

    def stream(self, sink: Sink, **values: object) -> None:
        """Writes the output piece by piece."""
        for _ in self.steps(sink, **values):
            pass

    def steps(self, sink: Sink, **values: object) -> Iterator[None]:
        """Writes the output, pausing after each turn of an outermost loop."""
        env = dict(values)
        for node, run in self._nodes:
            if isinstance(node, For):
                yield from _turns(node, _run(node.body), _value(node.over)(env), env, sink, False)
            else:
                run(env, sink, False)
                yield

    def render(self, **values: object) -> tuple[str, list[tuple[int, int]]]:
        """The output and the spans of it (code points) that a model is to learn."""
        out, spans, at = [], [], 0

        class Whole(Sink):
            def write(self, piece, learned):
                nonlocal at
                if piece:
                    if learned and spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + len(piece))
                    elif learned:
                        spans.append((at, at + len(piece)))
                    out.append(piece)
                    at += len(piece)

        self.stream(Whole(), **values)
        return "".join(out), spans


def messages_of(rows: Iterable[tuple[str | None, str | None]]) -> Stream:
    return Stream({"role": r or "", "text": t or ""} for r, t in rows)
