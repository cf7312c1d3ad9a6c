"""Operator 7, first half: a small sandboxed template language for conversations.

``compile_template`` parses a template into a syntax tree, folds constants and
turns the tree into Python closures that yield (text, under the loss mask?).

Language: ``{{ expr }}``; ``{% for x in expr %} … {% else %} … {% endfor %}`` with
``loop.first``, ``loop.last``, ``loop.index``, ``loop.index0``; ``{% if %} {% elif %}
{% else %} {% endif %}``; ``{% set x = expr %}``; ``{% generation %} …
{% endgeneration %}``; ``{# comment #}``; ``-`` at a tag's edge strips white space.
Expressions: literals, names, ``a.b`` and ``a['b']`` (keys of mappings only, never
Python attributes), ``+ - * ~ %``, comparisons, ``in``, ``and or not``, ``x if c else y``,
filters ``|name`` from a fixed table, ``is defined`` / ``is none``.

Nothing reaches Python objects: no calls, no attributes, no imports.  Loops are
lazy, so a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template does not follow the language."""


# -- control strings inside texts -------------------------------------------------------

_CONTROL = re.compile(r"<(\\*)\|")
_GUARDED = re.compile(r"<\\(\\*)\|")


def guard(text: str) -> str:
    """Make sure that ``<|`` does not occur: a backslash more before each bar that follows ``<``."""
    return _CONTROL.sub(r"<\\\1|", text) if "<" in text else text


def unguard(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text) if "<" in text else text


def guard_line(text: str) -> str:
    """``guard`` for a field that ends with its line."""
    return guard(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unguard_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unguard(text), flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"guard": guard, "guard_line": guard_line, "trim": lambda x: show(x).strip(), "upper": lambda x: show(x).upper(), "lower": lambda x: show(x).lower(), "length": lambda x: 0 if x is None else len(x), "string": lambda x: show(x)}

# -- syntax tree ------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A pure function of sub-expressions."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Lazy:
    """``and``, ``or``, ``if``: not all of the sub-expressions are evaluated."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Defined:
    name: str


@dataclass
class Out:
    value: Any


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class If:
    test: Any
    then: list
    other: list = field(default_factory=list)


@dataclass
class For:
    name: str
    over: Any
    body: list
    other: list = field(default_factory=list)


@dataclass
class Generation:
    body: list


#: Numbers that a template reckons with stay below this.
MOST_NUMBER = 1 << 53


def _reckon(f: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    """``f`` for integers and floats of bounded size only, so that no text or number grows beyond what a template was given."""

    def run(a: Any, b: Any) -> Any:
        if not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
            raise TypeError("a template reckons with numbers only; ~ joins texts")
        out = f(a, b)
        if abs(out) >= MOST_NUMBER:
            raise OverflowError("a number of a template is too large")
        return out

    return run


PURE: dict[str, Callable] = {
    "+": _reckon(operator.add), "-": _reckon(operator.sub), "*": _reckon(operator.mul), "%": _reckon(operator.mod), "~": lambda a, b: show(a) + show(b),
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not": operator.not_, "neg": operator.neg, "is none": lambda a: a is None,
} | {f"|{name}": f for name, f in FILTERS.items()}


def show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# -- reading ----------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%~<>|.\[\]()]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, Any]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            number, string, name, sign = m.groups()
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif string is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
            elif name is not None:
                self.tokens.append(("name", name))
            else:
                self.tokens.append(("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "const" and value in wanted:
                self.at += 1
                return value
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const(None)
            return Lazy("if", (test, value, other))
        return value

    def either(self) -> Any:
        left = self.both()
        while self.take("or"):
            left = Lazy("or", (left, self.both()))
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Lazy("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        if self.take("not"):
            return Apply("not", (self.negated(),))
        return self.compared()

    def compared(self) -> Any:
        left = self.summed()
        while True:
            if sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                left = Apply(sign, (left, self.summed()))
            elif self.at + 1 < len(self.tokens) and self.tokens[self.at] == ("name", "not") and self.tokens[self.at + 1] == ("name", "in"):
                self.at += 2
                left = Apply("not", (Apply("in", (left, self.summed())),))
            elif self.take("is"):
                inverse = self.take("not")
                test = self.take("defined", "none")
                if test == "defined" and isinstance(left, Name):
                    left = Defined(left.name)
                elif test == "none":
                    left = Apply("is none", (left,))
                else:
                    raise TemplateError("unknown test")
                left = Apply("not", (left,)) if inverse else left
            else:
                return left

    def summed(self) -> Any:
        left = self.scaled()
        while sign := self.take("+", "-", "~"):
            left = Apply(sign, (left, self.scaled()))
        return left

    def scaled(self) -> Any:
        left = self.filtered()
        while sign := self.take("*", "%"):
            left = Apply(sign, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        if self.take("-"):
            return Apply("neg", (self.filtered(),))
        value = self.atom()
        while True:
            if self.take("."):
                value = Item(value, Const(self.word()))
            elif self.take("["):
                value = Item(value, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.word()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                value = Apply(f"|{name}", (value,))
            else:
                return value

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression breaks off")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        if value == "(":
            inner = self.choice()
            self.need(")")
            return inner
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    root: list = []
    body, stack, at, strip = root, [], 0, False
    for m in _TAG.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if strip else text
        shown, code = m[2], m[5]
        left, strip = (m[1], bool(m[3])) if shown is not None else (m[4], bool(m[6])) if code is not None else ("", False)
        text = text.rstrip() if left else text
        at = m.end()
        if text:
            body.append(Out(Const(text)))
        if shown is not None:
            body.append(Out(_Expression(shown).whole()))
            continue
        if code is None:
            continue
        word, _, rest = code.strip().partition(" ")
        if word == "for":
            name, _, over = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError("for needs a name")
            node = For(name.strip(), _Expression(over).whole(), [])
            body.append(node)
            stack.append((word, node, body))
            body = node.body
        elif word == "if":
            node = If(_Expression(rest).whole(), [])
            body.append(node)
            stack.append((word, node, body))
            body = node.then
        elif word == "elif" and stack and stack[-1][0] == "if":
            node = If(_Expression(rest).whole(), [])
            stack[-1][1].other.append(node)
            stack[-1] = ("if", node, stack[-1][2])
            body = node.then
        elif word == "else" and stack and stack[-1][0] in ("if", "for"):
            body = stack[-1][1].other
        elif word == "generation":
            node = Generation([])
            body.append(node)
            stack.append((word, node, body))
            body = node.body
        elif word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError("set needs a name")
            body.append(Set(name.strip(), _Expression(value).whole()))
        elif word in ("endfor", "endif", "endgeneration") and stack and stack[-1][0] == word[3:]:
            body = stack.pop()[2]
        else:
            raise TemplateError(f"unexpected {{% {code.strip()} %}}")
    if stack:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    tail = template[at:].lstrip() if strip else template[at:]
    if tail:
        root.append(Out(Const(tail)))
    return root


# -- folding ----------------------------------------------------------------------------


def fold_expression(x: Any) -> Any:
    """Replace what does not depend on names by its value; errors stay for run time."""
    if isinstance(x, Item):
        return Item(fold_expression(x.of), fold_expression(x.key))
    if isinstance(x, Apply):
        args = tuple(map(fold_expression, x.args))
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(PURE[x.what](*(a.value for a in args)))
            except Exception:  # noqa: BLE001
                return Apply(x.what, args)
        return Apply(x.what, args)
    if isinstance(x, Lazy):
        args = tuple(map(fold_expression, x.args))
        if isinstance(args[0], Const):
            first = args[0].value
            return {"and": args[1] if first else args[0], "or": args[0] if first else args[1], "if": args[1] if first else args[-1]}[x.what]
        return Lazy(x.what, args)
    return x


def fold(nodes: list) -> list:
    out: list = []
    for node in nodes:
        if isinstance(node, Out):
            value = fold_expression(node.value)
            if isinstance(value, Const):
                text = show(value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Out(Const(text)))
            else:
                out.append(Out(value))
        elif isinstance(node, If):
            test = fold_expression(node.test)
            if isinstance(test, Const):
                out = fold([*out, *(node.then if test.value else node.other)])
            else:
                out.append(If(test, fold(node.then), fold(node.other)))
        elif isinstance(node, For):
            out.append(For(node.name, fold_expression(node.over), fold(node.body), fold(node.other)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        else:
            out.append(Set(node.name, fold_expression(node.value)))
    return out


# -- closures ---------------------------------------------------------------------------


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _value(x: Any) -> Callable[[dict], Any]:
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        return lambda env, n=x.name: env.get(n)
    if isinstance(x, Defined):
        return lambda env, n=x.name: n in env
    if isinstance(x, Item):
        of, key = _value(x.of), _value(x.key)
        return lambda env: _get(of(env), key(env))
    args = [_value(a) for a in x.args]
    if isinstance(x, Lazy):
        a, b = args[:2]
        if x.what == "and":
            return lambda env: a(env) and b(env)
        if x.what == "or":
            return lambda env: a(env) or b(env)
        return lambda env, c=args[2]: b(env) if a(env) else c(env)
    f = PURE[x.what]
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def _node(node: Any) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Out):
        value = _value(node.value)

        def put(env: dict, masked: bool) -> Iterator[Piece]:
            text = show(value(env))
            if text:
                yield text, masked

        return put
    if isinstance(node, Set):
        value = _value(node.value)

        def assign(env: dict, masked: bool) -> Iterator[Piece]:
            env[node.name] = value(env)
            yield from ()

        return assign
    if isinstance(node, Generation):
        body = _body(node.body)
        return lambda env, masked: body(env, True)
    if isinstance(node, If):
        test, then, other = _value(node.test), _body(node.then), _body(node.other)
        return lambda env, masked: then(env, masked) if test(env) else other(env, masked)
    over, body, other = _value(node.over), _body(node.body), _body(node.other)

    def loop(env: dict, masked: bool) -> Iterator[Piece]:
        items, at, nothing = iter(over(env) or ()), 0, object()
        item = next(items, nothing)
        if item is nothing:
            yield from other(env, masked)
        while item is not nothing:
            following = next(items, nothing)
            inner = env | {node.name: item, "loop": {"index": at + 1, "index0": at, "first": at == 0, "last": following is nothing}}
            yield from body(inner, masked)
            item, at = following, at + 1

    return loop


def _body(nodes: list) -> Callable[[dict, bool], Iterator[Piece]]:
    parts = [_node(n) for n in nodes]
    if len(parts) == 1:
        return parts[0]

    def all_of(env: dict, masked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(env, masked)

    return all_of


def compile_template(template: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, under the loss mask?) lazily."""
    run = _body(fold(parse(template)))
    return lambda **names: run(dict(names), False)


def render(template: str, messages: Iterable[Mapping], **names: Any) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans (code points) under the loss mask."""
    pieces, spans, at = [], [], 0
    for text, masked in compile_template(template)(messages=messages, **names):
        pieces.append(text)
        if masked:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)
    return "".join(pieces), spans
