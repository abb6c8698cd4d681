"""A small sandboxed template language, compiled to Python closures.

Source is cut into tokens, parsed into a tree, folded, and every node becomes a closure. Rendering is a
stream of (text, inside a generation block) pieces, so a conversation need not be held.

Language::

    {{ expression }}                                   output; null is empty
    {% for x in expression %} ... {% endfor %}         loop.index, index0, first, last, previous
    {% if expression %} ... {% elif ... %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}           marks what a model should produce
    {# comment #}

    or  and  not  == != < <= > >= in  ~ (join as text)  + - * %  x.name  x["name"]  x | filter  x | filter(...)
    'text'  "text"  12  true  false  none  (expression)

Sandbox: values are texts, integers, booleans, null, mappings with text keys and streams; a name or a key that
is missing is null. There are no calls but the filters below, no attributes of Python objects, no other loops than over
given data, and bounds on the nesting and on the length of a text made by ``*``. An error in a template raises
``TemplateError`` when it is compiled; a wrong type raises it when it is rendered.

Folding: an expression of constants (filters included) is worked out once, a constant condition leaves one branch,
neighbouring constant texts become one piece, and a loop over a constant null or empty text vanishes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any, NamedTuple

MAX_DEPTH = 50
MAX_TEXT = 1 << 20  # characters that "*" may make

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


# --- filters ---

OPENED = re.compile(r"<(\\*)\|")
CLOSED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: every ``<``, backslashes, ``|`` gets one more backslash. ``unescape`` is its inverse."""
    return OPENED.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return CLOSED.sub(r"<\1|", text)


def one_line(text: str) -> str:
    """Newlines and backslashes as ``\\n`` and ``\\\\``; ``lines_back`` is its inverse."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def lines_back(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts, numbers and booleans can be put out")


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda x: escape(as_text(x)),
    "one_line": lambda x: one_line(as_text(x)),
    "trim": lambda x: as_text(x).strip(),
    "upper": lambda x: as_text(x).upper(),
    "lower": lambda x: as_text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, Mapping)) else len(as_text(x)),
    "replace": lambda x, old, new: as_text(x).replace(as_text(old), as_text(new)),
    "default": lambda x, other: other if x is None else x,
}


# --- tree ---

class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Get(NamedTuple):
    of: Any
    key: Any


class Filter(NamedTuple):
    name: str
    arguments: tuple


class Unary(NamedTuple):
    sign: str
    of: Any


class Binary(NamedTuple):
    sign: str
    left: Any
    right: Any


class Text(NamedTuple):
    text: str


class Output(NamedTuple):
    value: Any


class If(NamedTuple):
    condition: Any
    then: tuple
    other: tuple


class For(NamedTuple):
    name: str
    over: Any
    body: tuple


class Set(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: tuple


# --- parser ---

BLOCKS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<sign>==|!=|<=|>=|[<>~+\-*%.|()\[\],=]))")
CONSTANTS = {"true": True, "false": False, "none": None}
RESERVED = {"and", "or", "not", "in", "loop", *CONSTANTS}
LEVELS = [("or",), ("and",), None, ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%")]


class Expression:
    """Tokens of one expression, read by precedence."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.depth = 0, 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        found = self.peek()
        if found[0] is None or (value is not None and found[1] != value) or (kind is not None and found[0] != kind):
            raise TemplateError(f"expected {value or kind or 'more'}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def is_sign(self, *signs: str) -> bool:
        kind, value = self.peek()
        return kind in ("sign", "name") and value in signs

    def whole(self) -> Any:
        tree = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def level(self, n: int) -> Any:
        if n == len(LEVELS):
            return self.postfix()
        if LEVELS[n] is None:
            if self.is_sign("not"):
                self.take()
                self.enter()
                tree = Unary("not", self.level(n))
                self.depth -= 1
                return tree
            return self.level(n + 1)
        tree = self.level(n + 1)
        joined = 0
        while self.is_sign(*LEVELS[n]):
            joined += 1
            if joined > MAX_DEPTH:
                raise TemplateError("too many operators in a row")
            tree = Binary(self.take(), tree, self.level(n + 1))
        return tree

    def enter(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")

    def postfix(self) -> Any:
        self.enter()
        tree, steps = self.primary(), 0
        while self.is_sign(".", "[", "|"):
            steps += 1
            if steps > MAX_DEPTH:
                raise TemplateError("too many steps in a row")
            sign = self.take()
            if sign == ".":
                tree = Get(tree, Const(self.take(kind="name")))
            elif sign == "[":
                tree = Get(tree, self.level(0))
                self.take("]")
            else:
                name, arguments = self.take(kind="name"), [tree]
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                if self.is_sign("("):
                    self.take()
                    while not self.is_sign(")"):
                        arguments.append(self.level(0))
                        if not self.is_sign(")"):
                            self.take(",")
                    self.take(")")
                if len(arguments) != FILTERS[name].__code__.co_argcount:
                    raise TemplateError(f"wrong number of arguments for {name}")
                tree = Filter(name, tuple(arguments))
        self.depth -= 1
        return tree

    def primary(self) -> Any:
        kind, value = self.peek()
        if self.is_sign("("):
            self.take()
            tree = self.level(0)
            self.take(")")
            return tree
        if self.is_sign("-"):
            self.take()
            return Unary("-", self.postfix())
        if kind == "number":
            return Const(int(self.take()))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1:-1], flags=re.S))
        if kind == "name" and value in CONSTANTS:
            return Const(CONSTANTS[self.take()])
        if kind == "name" and (value == "loop" or value not in RESERVED):
            return Name(self.take())
        raise TemplateError(f"expected a value, found {value!r}")


def parse(source: str) -> tuple:
    """Tree of a template: a tuple of nodes."""
    # A frame: opening word, its expression, finished (condition, body) branches, body so far.
    stack: list[list] = [["", None, [], []]]
    at = 0
    for found in BLOCKS.finditer(source):
        if found.start() > at:
            stack[-1][3].append(Text(source[at:found.start()]))
        at = found.end()
        if found[1] is not None:
            stack[-1][3].append(Output(Expression(found[1]).whole()))
        elif found[2] is not None:
            statement(found[2].strip(), stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    rest = source[at:]
    if "{{" in rest or "{%" in rest or "{#" in rest:
        raise TemplateError("a block is not closed")
    return tuple([*stack[0][3], *([Text(rest)] if rest else [])])


def statement(source: str, stack: list[list]) -> None:
    word, _, rest = source.partition(" ")
    top = stack[-1]
    if word in ("if", "for", "generation"):
        if len(stack) > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        if word == "generation" and (rest or any(frame[0] == "generation" for frame in stack)):
            raise TemplateError("generation blocks have no argument and do not nest")
        stack.append([word, head(word, rest), [], []])
    elif word in ("elif", "else") and top[0] == "if" and top[1] is not None:
        top[2].append((top[1], tuple(top[3])))
        top[1], top[3] = Expression(rest).whole() if word == "elif" else None, []
    elif word == f"end{top[0]}" and top[0] and not rest:
        stack.pop()
        stack[-1][3].append(closed(*top))
    elif word == "set":
        name, sign, value = rest.partition("=")
        if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in RESERVED:
            raise TemplateError(f"cannot set {rest!r}")
        top[3].append(Set(name.strip(), Expression(value).whole()))
    else:
        raise TemplateError(f"unexpected {source!r}")


def head(word: str, rest: str) -> Any:
    if word == "for":
        found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
        if not found or found[1] in RESERVED:
            raise TemplateError(f"cannot loop {rest!r}")
        return found[1], Expression(found[2]).whole()
    return Expression(rest).whole() if word == "if" else None


def closed(word: str, argument: Any, branches: list, body: list) -> Any:
    if word == "for":
        return For(*argument, tuple(body))
    if word == "generation":
        return Generation(tuple(body))
    other = tuple(body)
    if argument is not None:
        branches, other = [*branches, (argument, other)], ()
    for condition, then in reversed(branches):
        other = (If(condition, then, other),)
    return other[0]


# --- folding ---

def fold(node: Any) -> Any:
    """The expression with its constant parts worked out; what would fail stays for the rendering."""
    if isinstance(node, Get):
        node = Get(fold(node.of), fold(node.key))
        parts = (node.of, node.key)
    elif isinstance(node, Filter):
        node = Filter(node.name, tuple(map(fold, node.arguments)))
        parts = node.arguments
    elif isinstance(node, Unary):
        node = Unary(node.sign, fold(node.of))
        parts = (node.of,)
    elif isinstance(node, Binary):
        node = Binary(node.sign, fold(node.left), fold(node.right))
        parts = (node.left, node.right)
        if node.sign in ("and", "or") and isinstance(node.left, Const):
            return node.right if bool(node.left.value) == (node.sign == "and") else node.left
    else:
        return node
    if all(isinstance(p, Const) for p in parts):
        try:
            return Const(expression(node)({}))
        except TemplateError:
            return node
    return node


def fold_body(body: Iterable) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, Output):
            value = fold(node.value)
            try:
                parts: tuple = (Text(as_text(value.value)),) if isinstance(value, Const) else (Output(value),)
            except TemplateError:
                parts = (Output(value),)
        elif isinstance(node, If):
            condition = fold(node.condition)
            then, other = fold_body(node.then), fold_body(node.other)
            parts = (then if condition.value else other) if isinstance(condition, Const) else (If(condition, then, other),)
        elif isinstance(node, For):
            over, inner = fold(node.over), fold_body(node.body)
            parts = () if isinstance(over, Const) and not over.value else (For(node.name, over, inner),)
        elif isinstance(node, Generation):
            parts = (Generation(fold_body(node.body)),)
        elif isinstance(node, Set):
            parts = (Set(node.name, fold(node.value)),)
        else:
            parts = (node,)
        for part in parts:
            if isinstance(part, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + part.text)
            elif not isinstance(part, Text) or part.text:
                out.append(part)
    return tuple(out)


# --- closures ---

Scope = dict[str, Any]


def number(x: Any) -> int:
    if not isinstance(x, int) or isinstance(x, bool):
        raise TemplateError("expected a number")
    return x


def ordered(x: Any, y: Any) -> None:
    if type(x) is not type(y) or not isinstance(x, (str, int)):
        raise TemplateError("only two texts or two numbers have an order")


def added(x: Any, y: Any) -> Any:
    return x + y if isinstance(x, str) and isinstance(y, str) else number(x) + number(y)


def times(x: Any, y: Any) -> Any:
    if isinstance(x, str) and len(x) * max(number(y), 0) > MAX_TEXT:
        raise TemplateError("too long a text")
    return (x if isinstance(x, str) else number(x)) * number(y)


def remainder(x: Any, y: Any) -> int:
    if not number(y):
        raise TemplateError("division by zero")
    return number(x) % y


def contains(x: Any, y: Any) -> bool:
    if isinstance(y, Mapping):
        return isinstance(x, str) and x in y
    if not isinstance(x, str) or not isinstance(y, str):
        raise TemplateError("in needs a text in a text or a key in a mapping")
    return x in y


def compared(sign: str) -> Callable[[Any, Any], bool]:
    tests = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}

    def run(x: Any, y: Any) -> bool:
        ordered(x, y)
        return tests[sign](x, y)

    return run


def equal(x: Any, y: Any) -> bool:
    return type(x) is type(y) and x == y


OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": equal, "!=": lambda x, y: not equal(x, y), "in": contains, "~": lambda x, y: as_text(x) + as_text(y),
    "+": added, "-": lambda x, y: number(x) - number(y), "*": times, "%": remainder,
    **{s: compared(s) for s in ("<", "<=", ">", ">=")},
}


def key_of(of: Any, key: Any) -> Any:
    if of is None:
        return None
    if not isinstance(of, Mapping) or not isinstance(key, str):
        raise TemplateError("only mappings have keys")
    return of.get(key)


def expression(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Get):
        of, key = expression(node.of), expression(node.key)
        return lambda scope: key_of(of(scope), key(scope))
    if isinstance(node, Filter):
        run, parts = FILTERS[node.name], [expression(a) for a in node.arguments]
        if len(parts) == 1:
            only = parts[0]
            return lambda scope: run(only(scope))
        return lambda scope: run(*[p(scope) for p in parts])
    if isinstance(node, Unary):
        of = expression(node.of)
        return (lambda scope: not of(scope)) if node.sign == "not" else (lambda scope: -number(of(scope)))
    left, right = expression(node.left), expression(node.right)
    if node.sign == "and":
        return lambda scope: right(scope) if (x := left(scope)) else x
    if node.sign == "or":
        return lambda scope: x if (x := left(scope)) else right(scope)
    run = OPERATIONS[node.sign]
    return lambda scope: run(left(scope), right(scope))


Renderer = Callable[[Scope, bool], Iterator[Piece]]


def looped(node: For) -> Renderer:
    over, body, name = expression(node.over), sequence(node.body), node.name

    def run(scope: Scope, marked: bool) -> Iterator[Piece]:
        values = over(scope)
        if values is None or values == "":
            return
        if isinstance(values, (str, int, Mapping)):
            raise TemplateError("only streams can be looped over")
        outer = {k: scope[k] for k in (name, "loop") if k in scope}
        values, previous = iter(values), None
        # One value ahead, to know the last one.
        for i, (value, last) in enumerate(with_last(values)):
            scope[name] = value
            scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": last, "previous": previous}
            yield from body(scope, marked)
            previous = value
        for k in (name, "loop"):
            scope.pop(k, None)
        scope.update(outer)

    return run


def with_last(values: Iterator) -> Iterator[tuple[Any, bool]]:
    none = object()
    held = next(values, none)
    while held is not none:
        ahead = next(values, none)
        yield held, ahead is none
        held = ahead


def piece(node: Any) -> Renderer:
    if isinstance(node, Text):
        return lambda scope, marked, text=node.text: iter(((text, marked),))
    if isinstance(node, Output):
        value = expression(node.value)
        return lambda scope, marked: iter(((as_text(value(scope)), marked),))
    if isinstance(node, If):
        condition, then, other = expression(node.condition), sequence(node.then), sequence(node.other)
        return lambda scope, marked: (then if condition(scope) else other)(scope, marked)
    if isinstance(node, For):
        return looped(node)
    if isinstance(node, Generation):
        body = sequence(node.body)
        return lambda scope, marked: body(scope, True)
    value = expression(node.value)

    def put(scope: Scope, marked: bool) -> Iterator[Piece]:
        scope[node.name] = value(scope)
        return iter(())

    return put


def sequence(body: tuple) -> Renderer:
    parts = [piece(node) for node in body]

    def run(scope: Scope, marked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope, marked)

    return run


def compile_template(source: str) -> Callable[[Mapping[str, Any]], Iterator[Piece]]:
    """A function from values to the stream of (text, inside a generation block)."""
    run = sequence(fold_body(parse(source)))
    return lambda values: run(dict(values), False)
