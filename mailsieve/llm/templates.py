"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% set x = e %}   {# remark #}
    {% for x in e %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}

A minus inside of a mark ({%- or -%}) takes away white space next to it. Expressions
have strings, whole numbers, lists, true, false, none, names, x.key, x[key], + - * % ~,
comparisons, in, and, or, not, a if b else c, and filters with arguments (x | f(y)).

A template can do nothing but read: keys are looked up in mappings and lists alone, never
attributes of objects, filters are those of FILTERS and `escape`, there are no calls and
no endless loops, and a result has a greatest size. What is unknown is none, which
prints as nothing. A name set inside of a loop is forgotten with its round.

A source is split into marks and text, parsed into a tree of nodes, and folded:
expressions of constants become constants, branches that are never taken go, and
neighbouring texts become one. From what is left closures are made, one for each node.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

MOST_CHARS = 1 << 28  # of one printed value
MOST_BITS = 4096  # of a whole number
MOST_DEPTH = 50
MOST_TOKENS = 300  # of one mark

_MARK = re.compile(r"\{([{%#])(-?)")
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<end>-?[%}]\})|(?P<sign>==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "if", "else", "elif", "endif", "for", "endfor", "set", "generation", "endgeneration", *_WORDS}
_SLASHED = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else "true" if value is True else "false" if value is False else str(value)


FILTERS: dict[str, Callable[..., Any]] = {
    "trim": lambda s: _shown(s).strip(),
    "upper": lambda s: _shown(s).upper(),
    "lower": lambda s: _shown(s).lower(),
    "capitalize": lambda s: _shown(s).capitalize(),
    "length": lambda s: len(s) if isinstance(s, (str, list, dict)) else 0,
    "default": lambda s, other="": other if s is None else s,
    "join": lambda s, between="": _shown(between).join(map(_shown, s)) if isinstance(s, list) else _shown(s),
    "first": lambda s: s[0] if isinstance(s, (str, list)) and s else None,
    "last": lambda s: s[-1] if isinstance(s, (str, list)) and s else None,
}


# How many arguments a filter takes at the most; `escape` takes further control strings.
ARGUMENTS = {"default": 1, "join": 1, "escape": 20}


@lru_cache(maxsize=64)
def _escaper(controls: tuple[str, ...]) -> re.Pattern[str]:
    if any(len(c) < 2 or "\\" in c for c in controls):
        raise TemplateError("a control string has two characters at least, and no backslash")
    return re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls)]))


def escaped(text: str, controls: tuple[str, ...]) -> str:
    """`text` with a backslash behind every backslash and behind the first character of
    every control string, so that none occurs in what comes out. A lone backslash is
    never followed by another one, hence `unescaped` can tell them apart."""
    return _escaper(controls).sub(lambda m: m[0] + "\\", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


@dataclass
class Node:
    """kind, what it holds that is no node, and the nodes it is made of."""

    kind: str
    value: Any = None
    parts: list[Node] = field(default_factory=list)


@dataclass
class Output:
    """Text as it is made, its length in code points, and the spans under generation."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


# Reading.


def _tokens(source: str, at: int, closing: str) -> tuple[list[tuple[str, str]], int, bool]:
    """Tokens up to the closing mark, the place behind it, and whether it has a minus."""
    found = []
    while True:
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text at {at}")
        at = m.end()
        if m.lastgroup == "end":
            if m["end"].lstrip("-") == closing:
                return found, at, m["end"][0] == "-"
            raise TemplateError(f"mark closed by another at {at}")
        found.append((m.lastgroup, m[m.lastgroup]))
        if len(found) > MOST_TOKENS:
            raise TemplateError("a mark is too long")


def _marks(source: str) -> list[tuple[str, Any]]:
    """("text", string), ("print", tokens) and ("do", tokens)."""
    out, at, strip = [], 0, False
    while True:
        m = _MARK.search(source, at)
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m and m[2] else text
        if text:
            out.append(("text", text))
        if not m:
            return out
        if m[1] == "#":
            end = source.find("#}", m.end())
            if end < 0:
                raise TemplateError("remark without an end")
            at, strip = end + 2, source[end - 1] == "-" and end - 1 >= m.end()
            continue
        tokens, at, strip = _tokens(source, m.end(), "}}" if m[1] == "{" else "%}")
        out.append(("print" if m[1] == "{" else "do", tokens))


class _Expression:
    """Recursive descent over the tokens of one mark."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "string" else text

    def take(self, *wanted: str) -> str:
        if self.peek() is None or wanted and self.peek() not in wanted:
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}, found {self.peek()}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or text in _RESERVED:
            raise TemplateError(f"expected a name, found {text}")
        self.at += 1
        return text

    def whole(self) -> Node:
        node = self.choice()
        self.ended()
        return node

    def ended(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]}")

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        node = self.level(0)
        if self.peek() == "if":
            self.take()
            test = self.level(0)
            other = Node("constant")
            if self.peek() == "else":
                self.take()
                other = self.choice()
            node = Node("choice", None, [test, node, other])
        self.depth -= 1
        return node

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.filtered()
        signs = self.LEVELS[k]
        if signs == ("not",):
            times = 0
            while self.peek() == "not":
                self.take()
                times += 1
            node = self.level(k + 1)
            for _ in range(times):
                node = Node("not", None, [node])
            return node
        node = self.level(k + 1)
        while self.peek() in signs or (self.peek() == "not" and "in" in signs):
            sign = self.take()
            if sign == "not":
                self.take("in")
                node = Node("not", None, [Node("in", None, [node, self.level(k + 1)])])
            else:
                node = Node(sign, None, [node, self.level(k + 1)])
        return node

    def filtered(self) -> Node:
        node = self.single()
        while self.peek() in ("|", ".", "["):
            sign = self.take()
            if sign == "|":
                node = Node("filter", self.name(), [node, *(self.several(")") if self.peek() == "(" and self.take() else [])])
            elif sign == ".":
                node = Node("item", None, [node, Node("constant", self.name())])
            else:
                node = Node("item", None, [node, self.choice()])
                self.take("]")
        return node

    def several(self, closing: str) -> list[Node]:
        nodes = []
        while self.peek() != closing:
            nodes.append(self.choice())
            if self.peek() != closing:
                self.take(",")
        self.take(closing)
        return nodes

    def single(self) -> Node:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "string":
            self.at += 1
            return Node("constant", re.sub(r"\\(.)", lambda m: _SLASHED.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Node("constant", int(text))
        if text in _WORDS:
            self.at += 1
            return Node("constant", _WORDS[text])
        if kind == "name":
            return Node("name", self.name())
        sign = self.take("(", "[", "-")
        if sign == "-":
            return Node("-", None, [Node("constant", 0), self.filtered()])
        if sign == "[":
            return Node("list", None, self.several("]"))
        node = self.choice()
        self.take(")")
        return node


def parse(source: str) -> Node:
    marks, at = _marks(source), 0

    def body(*closing: str, depth: int = 0) -> tuple[Node, str, _Expression | None]:
        nonlocal at
        if depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        nodes = []
        while at < len(marks):
            kind, held = marks[at]
            at += 1
            if kind == "text":
                nodes.append(Node("text", held))
                continue
            e = _Expression(held)
            if kind == "print":
                nodes.append(Node("print", None, [e.whole()]))
                continue
            word = e.take()
            if word in closing:
                return Node("body", None, nodes), word, e
            if word == "set":
                name = e.name()
                e.take("=")
                nodes.append(Node("set", name, [e.whole()]))
            elif word == "for":
                name = e.name()
                e.take("in")
                over = e.whole()
                inside, _, last = body("endfor", depth=depth + 1)
                last.ended()
                nodes.append(Node("for", name, [over, inside]))
            elif word == "generation":
                e.ended()
                inside, _, last = body("endgeneration", depth=depth + 1)
                last.ended()
                nodes.append(Node("generation", None, [inside]))
            elif word == "if":
                parts, test, other = [], e.whole(), Node("body")
                while True:
                    inside, word, more = body("elif", "else", "endif", depth=depth + 1)
                    parts += [test, inside]
                    if word != "elif":
                        more.ended()
                        break
                    test = more.whole()
                if word == "else":
                    other, _, more = body("endif", depth=depth + 1)
                    more.ended()
                nodes.append(Node("if", None, [*parts, other]))
            else:
                raise TemplateError(f"unknown statement {word}")
        if closing:
            raise TemplateError(f"{closing[-1]} is missing")
        return Node("body", None, nodes), "", None

    return body()[0]


# Folding.

def folded(node: Node, filters: dict[str, Callable[..., Any]]) -> Node:
    parts = [folded(p, filters) for p in node.parts]
    node = Node(node.kind, node.value, parts)
    constant = all(p.kind == "constant" for p in parts)
    if node.kind in ("choice", "and", "or") and parts[0].kind == "constant":
        if node.kind == "choice":
            return parts[1] if parts[0].value else parts[2]
        return parts[1] if bool(parts[0].value) == (node.kind == "and") else parts[0]
    if node.kind not in ("constant", "name", "text", "print", "body", "set", "for", "if", "generation") and constant:
        value = _expression(node, filters)({})
        return node if isinstance(value, (list, dict)) else Node("constant", value)
    if node.kind == "print" and constant:
        return Node("text", _shown(parts[0].value))
    if node.kind == "if":
        kept = []
        for test, inside in zip(parts[:-1:2], parts[1::2]):
            if test.kind != "constant":
                kept += [test, inside]
            elif test.value:
                return Node("if", None, [*kept, inside]) if kept else inside
        return Node("if", None, [*kept, parts[-1]]) if kept else parts[-1]
    if node.kind == "body":
        out: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "body" else [p]:
                if q.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", out[-1].value + q.value)
                elif q.kind != "text" or q.value:
                    out.append(q)
        return Node("body", None, out)
    return node


# Closures.


def _looked_up(holder: Any, key: Any) -> Any:
    if isinstance(holder, dict):
        return holder.get(key) if isinstance(key, (str, int)) else None
    if isinstance(holder, (list, str)) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    return None


def _number(value: Any) -> int:
    return int(value) if isinstance(value, int) else 0


def _held(value: int) -> int:
    if value.bit_length() > MOST_BITS:
        raise TemplateError("a number is too large")
    return value


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return a in b if isinstance(b, list) or isinstance(b, dict) and isinstance(a, (str, int)) else False


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return _held(a + b)
    if isinstance(a, list) and isinstance(b, list):
        return a + b
    return _joined(a, b)


def _joined(a: Any, b: Any) -> str:
    text = _shown(a) + _shown(b)
    if len(text) > MOST_CHARS:
        raise TemplateError("a value is too long")
    return text


def _compared(a: Any, b: Any, test: Callable[[Any, Any], bool]) -> bool:
    same = isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int)
    return same and test(a, b)


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: _compared(a, b, lambda x, y: x < y),
    "<=": lambda a, b: _compared(a, b, lambda x, y: x <= y),
    ">": lambda a, b: _compared(a, b, lambda x, y: x > y),
    ">=": lambda a, b: _compared(a, b, lambda x, y: x >= y),
    "in": _within,
    "+": _plus,
    "~": _joined,
    "-": lambda a, b: _held(_number(a) - _number(b)),
    "*": lambda a, b: _held(_number(a) * _number(b)),
    "%": lambda a, b: _number(a) % _number(b) if _number(b) else 0,
}


def _expression(node: Node, filters: dict[str, Callable[..., Any]]) -> Callable[[dict], Any]:
    parts = [_expression(p, filters) for p in node.parts]
    value = node.value
    if node.kind == "constant":
        return lambda names: value
    if node.kind == "name":
        return lambda names: names.get(value)
    if node.kind == "list":
        return lambda names: [p(names) for p in parts]
    if node.kind == "filter":
        if value not in filters:
            raise TemplateError(f"unknown filter {value}")
        if len(parts) - 1 > ARGUMENTS.get(value, 0):
            raise TemplateError(f"too many arguments for {value}")
        apply, first, rest = filters[value], parts[0], parts[1:]
        if not rest:
            return lambda names: apply(first(names))
        return lambda names: apply(first(names), *(r(names) for r in rest))
    if node.kind == "not":
        (one,) = parts
        return lambda names: not one(names)
    if node.kind == "choice":
        test, yes, no = parts
        return lambda names: yes(names) if test(names) else no(names)
    one, two = parts
    if node.kind == "and":
        return lambda names: one(names) and two(names)
    if node.kind == "or":
        return lambda names: one(names) or two(names)
    if node.kind == "item":
        return lambda names: _looked_up(one(names), two(names))
    operator = _OPERATORS[node.kind]
    return lambda names: operator(one(names), two(names))


Run = Callable[[dict, Output], None]


def _statement(node: Node, filters: dict[str, Callable[..., Any]]) -> Run:
    if node.kind == "body":
        steps = [_statement(p, filters) for p in node.parts]

        def run_all(names: dict, out: Output) -> None:
            for step in steps:
                step(names, out)

        return steps[0] if len(steps) == 1 else run_all
    if node.kind == "text":
        text = node.value
        return lambda names, out: out.write(text)
    if node.kind == "print":
        printed = _expression(node.parts[0], filters)
        return lambda names, out: out.write(_shown(printed(names)))
    if node.kind == "set":
        given, name = _expression(node.parts[0], filters), node.value
        return lambda names, out: names.__setitem__(name, given(names))
    if node.kind == "generation":
        inside = _statement(node.parts[0], filters)

        def generate(names: dict, out: Output) -> None:
            start = out.length
            inside(names, out)
            if out.length > start:
                out.spans.append((start, out.length))

        return generate
    if node.kind == "for":
        over, one_round = _expression(node.parts[0], filters), _loop_round(node, filters)

        def loop(names: dict, out: Output) -> None:
            items = over(names)
            items = items if isinstance(items, list) else list(items) if isinstance(items, (str, dict)) else []
            for k, item in enumerate(items):
                one_round(names, out, item, k, len(items))

        return loop
    tests = [(_expression(t, filters), _statement(b, filters)) for t, b in zip(node.parts[:-1:2], node.parts[1::2])]
    other = _statement(node.parts[-1], filters)

    def branch(names: dict, out: Output) -> None:
        for test, inside in tests:
            if test(names):
                return inside(names, out)
        other(names, out)

    return branch


def _loop_round(node: Node, filters: dict[str, Callable[..., Any]]) -> Callable[[dict, Output, Any, int, int], None]:
    name, inside = node.value, _statement(node.parts[1], filters)

    def one_round(names: dict, out: Output, item: Any, k: int, n: int) -> None:
        inside(names | {name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n}}, out)

    return one_round


def _uses(node: Node, name: str) -> int:
    return (node.kind == "name" and node.value == name) + sum(_uses(p, name) for p in node.parts)


class Template:
    """A compiled template. Where the turns are used in a single loop on the outermost
    level and nowhere else (`by_turn`), any run of turns can be rendered by itself."""

    def __init__(self, source: str, controls: tuple[str, ...] = (), turns: str = "messages"):
        self.controls = tuple(controls)
        _escaper(self.controls)
        escape = lambda s, *more: escaped(_shown(s), self.controls + tuple(map(_shown, more)))
        filters = FILTERS | {"escape": escape}
        self.tree = folded(parse(source), filters)
        self.turns = turns
        places = [i for i, n in enumerate(self.tree.parts) if n.kind == "for" and n.parts[0].kind == "name" and n.parts[0].value == turns]
        self.by_turn = len(places) == 1 and _uses(self.tree, turns) == 1
        if self.by_turn:
            at = places[0]
            self._before = _statement(Node("body", None, self.tree.parts[:at]), filters)
            self._round = _loop_round(self.tree.parts[at], filters)
            self._after = _statement(Node("body", None, self.tree.parts[at + 1 :]), filters)
        self._all = _statement(self.tree, filters)

    def render(self, turns: Iterable[dict], **names: Any) -> Output:
        """A whole conversation."""
        out = Output()
        self._all({**names, self.turns: list(turns)}, out)
        return out

    def begin(self, first: bool, **names: Any) -> tuple[dict, Output]:
        """The names that a run of turns is rendered with, and its output so far: what
        stands before the loop if the run is the first one."""
        names, out = dict(names), Output()
        self._before(names, out)
        return names, out if first else Output()

    def turn(self, names: dict, out: Output, item: dict, index: int, of: int) -> None:
        self._round(names, out, item, index, of)
        if index == of - 1:
            self._after(names, out)
