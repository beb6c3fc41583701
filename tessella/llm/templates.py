"""A small template language, compiled to Python closures. Nothing in a template can reach Python.

    {{ expression }}                       output
    {% for x in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   what is output here is marked
    {# comment #}                          and {%- -%} {{- -}} strip white space beside them

Expressions: strings, whole numbers, true, false, none, names, x.name and x['name'] (entries of
dicts only, never Python attributes), `loop.first`, `loop.last`, `loop.index0`, and or not,
== != < > <= >=, in, + - * %, ~ (joins as text), and filters: upper, lower, trim, length, default(x), escape.
Constants are folded, conditions on constants choose their branch when the template is compiled,
and neighbouring constant texts are joined.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that can't be compiled, or a value it can't work with."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Entry:
    of: Any
    key: Any


@dataclass(frozen=True)
class Call:
    """An operator or filter by name, with its arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Let:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+\-*%~|.,()\[\]=]))""", re.DOTALL)
_UNESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
#: Entries of a string repeated or a number raised could fill memory; texts are joined only.
MOST_CONSTANT = 100_000


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


def _entry(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _number(f: Callable) -> Callable:
    def run(a, b):
        if not all(isinstance(x, int) for x in (a, b)):
            raise TemplateError("arithmetic needs numbers")
        return f(a, b)

    return run


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        return a + b
    return _number(operator.add)(a, b)


_CALLS: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "in": lambda a, b: a in b if isinstance(b, (str, list, tuple, dict)) else False,
    "not": lambda a: not a,
    "+": _plus,
    "-": _number(operator.sub),
    "*": _number(operator.mul),
    "%": _number(operator.mod),
    "~": lambda a, b: _text(a) + _text(b),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, dict)) else 0,
    "default": lambda x, y: y if x is None else x,
}
_FILTERS = {"upper": 0, "lower": 0, "trim": 0, "length": 0, "default": 1, "escape": 0}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _UNESCAPED.get(x[1], x[1]), m[2][1:-1], flags=re.DOTALL)))
            elif m[3]:
                self.tokens.append(("name", m[3]))
            else:
                self.tokens.append(("mark", m[4]))
        self.at = 0

    def peek(self, kind: str, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (not values or self.tokens[self.at][1] in values)

    def take(self, kind: str, *values: str) -> Any:
        if not self.peek(kind, *values):
            raise TemplateError(f"expected {' or '.join(values) or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.peek("name", "or"):
            self.at += 1
            out = Call("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.peek("name", "and"):
            self.at += 1
            out = Call("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        if self.peek("name", "not"):
            self.at += 1
            return Call("not", (self.negated(),))
        return self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while self.peek("mark", "==", "!=", "<", ">", "<=", ">=") or self.peek("name", "in"):
            self.at += 1
            out = Call(self.tokens[self.at - 1][1], (out, self.joined()))
        return out

    def joined(self) -> Any:
        out = self.summed()
        while self.peek("mark", "~"):
            self.at += 1
            out = Call("~", (out, self.summed()))
        return out

    def summed(self) -> Any:
        out = self.product()
        while self.peek("mark", "+", "-"):
            self.at += 1
            out = Call(self.tokens[self.at - 1][1], (out, self.product()))
        return out

    def product(self) -> Any:
        out = self.filtered()
        while self.peek("mark", "*", "%"):
            self.at += 1
            out = Call(self.tokens[self.at - 1][1], (out, self.filtered()))
        return out

    def filtered(self) -> Any:
        out = self.part()
        while self.peek("mark", "|"):
            self.at += 1
            name = self.take("name")
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name!r}")
            more = []
            if _FILTERS[name]:
                self.take("mark", "(")
                more = [self.either()]
                self.take("mark", ")")
            out = Call(name, (out, *more))
        return out

    def part(self) -> Any:
        if self.peek("mark", "("):
            self.at += 1
            out = self.either()
            self.take("mark", ")")
        elif self.peek("const"):
            out = Const(self.take("const"))
        else:
            name = self.take("name")
            if name in ("and", "or", "not", "in"):
                raise TemplateError(f"unexpected {name!r}")
            out = Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)
        while self.peek("mark", ".", "["):
            if self.take("mark", ".", "[") == ".":
                out = Entry(out, Const(self.take("name")))
            else:
                out = Entry(out, self.either())
                self.take("mark", "]")
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PIECE.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if m[1] or m[4]:
            text = text.rstrip()
        pieces.append(("text", text))
        strip, at = bool(m[3] or m[6]), m.end()
        if m[2] is not None:
            pieces.append(("output", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
    rest = source[at:].lstrip() if strip else source[at:]
    pieces.append(("text", rest))
    if any(kind == "text" and re.search(r"\{\{|\{%|\{#", value) for kind, value in pieces):
        raise TemplateError("a tag is not closed")
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        out: list = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                if value:
                    out.append(Text(value))
                continue
            if kind == "output":
                out.append(Output(_Expression(value).whole()))
                continue
            word, _, more = value.partition(" ")
            if word in ends:
                return tuple(out), value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", more.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                out.append(For(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                out.append(choice(more))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", more.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                out.append(Let(m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                out.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def choice(test: str) -> If:
        then, end = body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), then, (choice(end[4:]),))
        other = body("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), then, other)

    return body()[0]


def _same(values: tuple) -> bool:
    return all(isinstance(x, Const) for x in values)


def _fold_expression(x: Any) -> Any:
    if isinstance(x, Entry):
        of, key = _fold_expression(x.of), _fold_expression(x.key)
        return Const(_entry(of.value, key.value)) if _same((of, key)) else Entry(of, key)
    if not isinstance(x, Call):
        return x
    args = tuple(map(_fold_expression, x.args))
    if x.name in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (x.name == "and") else args[0]
        return Call(x.name, args)
    if x.name == "escape" or not _same(args):
        return Call(x.name, args)
    try:
        value = _CALLS[x.name](*(a.value for a in args))
    except (TypeError, ZeroDivisionError, TemplateError):
        return Call(x.name, args)  # it fails when it is rendered, if ever
    return Const(value) if not isinstance(value, str) or len(value) <= MOST_CONSTANT else Call(x.name, args)


def fold(nodes: tuple) -> tuple:
    """The tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif node != Text(""):
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            value = _fold_expression(node.value)
            add(Text(_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, If):
            test = _fold_expression(node.test)
            if isinstance(test, Const):
                for inner in fold(node.then if test.value else node.other):
                    add(inner)
            else:
                add(If(test, fold(node.then), fold(node.other)))
        elif isinstance(node, For):
            over, inner = _fold_expression(node.over), fold(node.body)
            if inner and not (isinstance(over, Const) and not over.value):
                add(For(node.name, over, inner))
        elif isinstance(node, Let):
            add(Let(node.name, _fold_expression(node.value)))
        elif isinstance(node, Generation):
            inner = fold(node.body)
            if inner:
                add(Generation(inner))
        else:
            add(node)
    return tuple(out)


class _Sink:
    """What has been output so far, how long it is, and which parts are marked."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _expression(x: Any, escape: Callable[[str], str]) -> Callable[[dict], Any]:
    if isinstance(x, Const):
        return lambda scope, v=x.value: v
    if isinstance(x, Name):
        return lambda scope, n=x.name: scope.get(n)
    if isinstance(x, Entry):
        of, key = _expression(x.of, escape), _expression(x.key, escape)
        return lambda scope: _entry(of(scope), key(scope))
    args = [_expression(a, escape) for a in x.args]
    if x.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if x.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if x.name == "escape":
        return lambda scope: escape(_text(args[0](scope)))
    call = _CALLS[x.name]

    def run(scope: dict) -> Any:
        try:
            return call(*(a(scope) for a in args))
        except (TypeError, ZeroDivisionError) as e:
            raise TemplateError(str(e)) from None

    return run


def _body(nodes: tuple, escape: Callable[[str], str]) -> Callable[[dict, _Sink], None]:
    steps = [_node(x, escape) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, sink: _Sink) -> None:
        for step in steps:
            step(scope, sink)

    return run


def _node(x: Any, escape: Callable[[str], str]) -> Callable[[dict, _Sink], None]:
    if isinstance(x, Text):
        return lambda scope, sink, v=x.value: sink.write(v)
    if isinstance(x, Output):
        value = _expression(x.value, escape)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(x, Let):
        value = _expression(x.value, escape)
        return lambda scope, sink, n=x.name: scope.__setitem__(n, value(scope))
    if isinstance(x, If):
        test, then, other = _expression(x.test, escape), _body(x.then, escape), _body(x.other, escape)
        return lambda scope, sink: (then if test(scope) else other)(scope, sink)
    inner = _body(x.body, escape)
    if isinstance(x, Generation):

        def mark(scope: dict, sink: _Sink) -> None:
            start = sink.length
            inner(scope, sink)
            if sink.length > start:
                sink.marks.append((start, sink.length))

        return mark
    over = _expression(x.over, escape)

    def loop(scope: dict, sink: _Sink) -> None:
        items = over(scope)
        if not isinstance(items, (list, tuple)):
            return
        own = dict(scope)
        for k, item in enumerate(items):
            own[x.name] = item
            own["loop"] = {"first": k == 0, "last": k == len(items) - 1, "index0": k}
            inner(own, sink)

    return loop


def compile_template(source: str, escape: Callable[[str], str] = lambda x: x) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a dict of names to (output, marked parts as code point offsets, end exclusive)."""
    run = _body(fold(parse(source)), escape)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        run(dict(names), sink)
        return "".join(sink.parts), sink.marks

    return render
