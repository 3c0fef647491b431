"""Chat formatting: a sandboxed template language, compiled to Python closures.

``compile_template`` parses a template into a syntax tree, folds its constants and builds
one closure per node. Closures are generators over a stream of messages, so that a
conversation of any length is rendered in bounded memory; text inside ``{% generation %}``
blocks is marked. Inserted values are escaped: a backslash is doubled and one is put after
the first character of each control string, so that a text can never forge a marker and
``unescape`` gives it back.

The language: ``{{ value }}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in xs %} {% endfor %}``, ``{% set name = value %}``, ``{% generation %}
{% endgeneration %}``, ``{# comment #}``; values are strings, integers, names, ``a.b``,
``a['b']``, ``loop.first/last/index/index0``, ``== != < <= > >= in not and or + ~`` and the
filters trim, upper, lower, length, default, raw. There are no calls, and names reach
nothing but the given variables, so a template cannot run other code.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own;
rows of equal turn go by role, then text, and repeated rows are repeated turns; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from diffusio.session import ship

TURNS = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role }}[SAYS]{{ m.text }}[/ROLE]"
    "{% endif %}{% endfor %}"
)
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[SAYS]", "[/ROLE]")
CHUNK_CHARS = 1 << 20


class TemplateError(ValueError):
    """The template isn't in the language."""


class Node(NamedTuple):
    """kind and parts: text(value) show(expr) if(branches, else) for(name, expr, body) set(name, expr) mark(body)."""

    kind: str
    parts: tuple


class Const(NamedTuple):
    value: Any


class Op(NamedTuple):
    """kind: name, item, not, and, or, filter or a binary operator."""

    kind: str
    args: tuple


_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.\[\]()]))")
_WORD = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            kind = ("int", "str", "name", "op")[m.lastindex - 1]
            self.tokens.append(("op" if kind == "name" and m[3] in _WORD else kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self):
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            return Op(op, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self):
        left = self.member()
        while self.take("|"):
            name, args = self.name(), ()
            if name not in _FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                args = (self.either(),)
                if not self.take(")"):
                    raise TemplateError("a ) is missing")
            left = Op("filter", (name, left, *args))
        return left

    def member(self):
        left = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                left = Op("item", (left, Const(self.name())))
            else:
                left = Op("item", (left, self.either()))
                if not self.take("]"):
                    raise TemplateError("a ] is missing")
        return left

    def atom(self):
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Const(int(text))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(text) or Op("name", (text,))
        raise TemplateError(f"unexpected {text!r}")


class Raw(str):
    """A string that isn't escaped."""


def _string(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


_FILTERS: dict[str, Callable] = {
    "trim": lambda x: _string(x).strip(),
    "upper": lambda x: _string(x).upper(),
    "lower": lambda x: _string(x).lower(),
    "length": lambda x: len(x or ""),
    "default": lambda x, d="": d if x is None else x,
    "raw": lambda x: Raw(_string(x)),
}
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _string(a) + _string(b),
}


def parse(source: str) -> tuple[Node, ...]:
    """The syntax tree of a template."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S)
    stack: list[tuple[str, Any, list[Node]]] = [("", None, [])]
    for piece in pieces:
        body = stack[-1][2]
        if piece.startswith("{{"):
            body.append(Node("show", (_Expression(piece[2:-2]).whole(),)))
        elif piece.startswith("{#"):
            continue
        elif piece.startswith("{%"):
            word, _, rest = piece[2:-2].strip().partition(" ")
            if word == "if":
                stack.append(("if", [(_Expression(rest).whole(), [])], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][-1][1])
            elif word in ("elif", "else"):
                if stack[-1][0] != "if":
                    raise TemplateError(f"{word} without if")
                branches = stack[-1][1]
                branches.append((_Expression(rest).whole() if word == "elif" else Const(True), []))
                stack[-1] = ("if", branches, branches[-1][1])
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"not a loop: {rest}")
                stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"not an assignment: {rest}")
                body.append(Node("set", (m[1], _Expression(m[2]).whole())))
            elif word.startswith("end"):
                kind, head, inner = stack.pop()
                if not stack or word != f"end{kind}":
                    raise TemplateError(f"unexpected {word}")
                made = {"if": lambda: Node("if", (tuple((c, tuple(b)) for c, b in head),)), "for": lambda: Node("for", (*head, tuple(inner))), "generation": lambda: Node("mark", (tuple(inner),))}[kind]()
                stack[-1][2].append(made)
            else:
                raise TemplateError(f"unknown block {word}")
        elif piece:
            body.append(Node("text", (piece,)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't ended")
    return tuple(stack[0][2])


def fold_value(e):
    """The expression with constant parts computed."""
    if isinstance(e, Const):
        return e
    args = tuple(fold_value(a) if isinstance(a, (Const, Op)) else a for a in e.args)
    values = [a for a in args if isinstance(a, (Const, Op))]
    if e.kind != "name" and all(isinstance(a, Const) for a in values):
        return Const(_closure(Op(e.kind, args))({}))
    if e.kind in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
    return Op(e.kind, args)


def fold(nodes: tuple[Node, ...], escape: Callable[[str], str] = lambda x: x) -> tuple[Node, ...]:
    """The tree with constants folded, dead branches dropped and neighbouring texts merged."""
    out: list[Node] = []
    for n in nodes:
        made: tuple[Node, ...] = (n,)
        if n.kind == "show":
            e = fold_value(n.parts[0])
            made = (Node("text", (_shown(e.value, escape),)),) if isinstance(e, Const) else (Node("show", (e,)),)
        elif n.kind == "if":
            branches = []
            for c, body in n.parts[0]:
                c = fold_value(c)
                if isinstance(c, Const) and not c.value:
                    continue
                branches.append((c, fold(body, escape)))
                if isinstance(c, Const):
                    break
            if not branches:
                made = ()
            elif isinstance(branches[0][0], Const):
                made = branches[0][1]
            else:
                made = (Node("if", (tuple(branches),)),)
        elif n.kind == "for":
            made = (Node("for", (n.parts[0], fold_value(n.parts[1]), fold(n.parts[2], escape))),)
        elif n.kind == "mark":
            made = (Node("mark", (fold(n.parts[0], escape),)),)
        elif n.kind == "set":
            made = (Node("set", (n.parts[0], fold_value(n.parts[1]))),)
        for x in made:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].parts[0] + x.parts[0],))
            else:
                out.append(x)
    return tuple(out)


def _shown(value: Any, escape: Callable[[str], str]) -> str:
    return str(value) if isinstance(value, Raw) else escape(_string(value))


def _item(holder: Any, key: Any) -> Any:
    return holder.get(key) if isinstance(holder, dict) else None


def _closure(e) -> Callable[[dict], Any]:
    """A function of the variables for an expression."""
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if e.kind == "name":
        name = e.args[0]
        return lambda env: env.get(name)
    if e.kind == "filter":
        f, args = _FILTERS[e.args[0]], [_closure(a) for a in e.args[1:]]
        return lambda env: f(*[a(env) for a in args])
    args = [_closure(a) for a in e.args]
    if e.kind == "item":
        return lambda env: _item(args[0](env), args[1](env))
    if e.kind == "not":
        return lambda env: not args[0](env)
    if e.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    f = _BINARY[e.kind]
    return lambda env: f(args[0](env), args[1](env))


Piece = tuple[str, bool]


def _generate(nodes: tuple[Node, ...], marked: bool, escape: Callable[[str], str]) -> Callable[[dict], Iterator[Piece]]:
    """A generator function of the variables: pieces of text and whether they are marked."""

    def text(n: Node):
        piece = (n.parts[0], marked)
        return lambda env: iter((piece,))

    def show(n: Node):
        value = _closure(n.parts[0])
        return lambda env: iter(((_shown(value(env), escape), marked),))

    def choose(n: Node):
        branches = [(_closure(c), _generate(b, marked, escape)) for c, b in n.parts[0]]

        def run(env):
            for condition, body in branches:
                if condition(env):
                    yield from body(env)
                    return

        return run

    def loop(n: Node):
        name, items, body = n.parts[0], _closure(n.parts[1]), _generate(n.parts[2], marked, escape)

        def run(env):
            stream = iter(items(env) or ())
            ahead, index = next(stream, stream), 0
            while ahead is not stream:  # the stream itself stands for its end
                now, ahead = ahead, next(stream, stream)
                yield from body(env | {name: now, "loop": {"first": not index, "last": ahead is stream, "index0": index, "index": index + 1}})
                index += 1

        return run

    def assign(n: Node):
        value = _closure(n.parts[1])

        def run(env):
            env[n.parts[0]] = value(env)
            return iter(())

        return run

    def mark(n: Node):
        return _generate(n.parts[0], True, escape)

    steps = [{"text": text, "show": show, "if": choose, "for": loop, "set": assign, "mark": mark}[n.kind](n) for n in nodes]

    def body(env: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(env)

    return body


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    """A reversible function after which no text holds a control string."""
    if not controls:
        return lambda text: text
    for a in controls:
        if "\\" in a or len(a) < 2:
            raise TemplateError(f"not a control string: {a!r}")
        for b in controls:
            if any(a.endswith(b[:k]) for k in range(1, len(b)) if len(a) > k):
                raise TemplateError(f"{a!r} may run into {b!r}")
    pattern = re.compile(r"\\|(?=" + "|".join(map(re.escape, controls)) + ")[\\s\\S]")
    return lambda text: pattern.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    """The text that was escaped: a backslash after any character is dropped, that character kept."""
    return re.sub(r"([\s\S])\\", r"\1", text) if "\\" in text else text


def compile_template(source: str, controls: tuple[str, ...] = CONTROLS) -> Callable[[dict], Iterator[Piece]]:
    """Parse, fold, and build the generator of a template's pieces."""
    escape = escaper(controls)
    return _generate(fold(parse(source), escape), False, escape)


def format_conversations(conversations: DataFrame, template: str = TURNS, controls: tuple[str, ...] = CONTROLS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Render conversations (conv_id, turn, role, text).

    Returns conv_id, chunk, text, spans: the formatted text in consecutive chunks of about
    chunk_chars (one, unless the conversation is very long), each with the spans, in code
    points of the chunk, that the loss covers. A conversation's chunks stand in order in
    one partition. Rows stream through; nothing is held but one chunk.
    """
    ship(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces_of = compile_template(template, controls)
        made: list[tuple] = []
        for conv, messages in _runs((conv, {"role": role, "text": text}) for b in batches for conv, role, text in zip(_keys(b.conv_id), b.role, b.text, strict=True)):
            chunk, parts, spans, size = 0, [], [], 0
            for piece, marked in pieces_of({"messages": messages}):
                if marked and piece:
                    spans.append({"start": size, "end": size + len(piece)})
                parts.append(piece)
                size += len(piece)
                if size >= chunk_chars:
                    yield _frame([(conv, chunk, "".join(parts), spans)])
                    chunk, parts, spans, size = chunk + 1, [], [], 0
            for _ in messages:  # a template may not read all
                pass
            if parts or not chunk:
                made.append((conv, chunk, "".join(parts), spans))
            if len(made) >= 512:
                yield _frame(made)
                made = []
        if made:
            yield _frame(made)

    return rows.mapInPandas(render, "conv_id long, chunk int, text string, spans array<struct<start: long, end: long>>")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "chunk", "text", "spans"])
    out["conv_id"] = out.conv_id.astype("Int64")
    return out


def _keys(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[Any, Iterator]]:
    """Like itertools.groupby over (key, value), with values alone."""
    rows = iter(rows)
    end: Any = object()
    state = [next(rows, (end, None))]

    def values(key):
        while state[0][0] is not end and state[0][0] == key:
            value = state[0][1]
            state[0] = next(rows, (end, None))
            yield value

    while state[0][0] is not end:
        key = state[0][0]
        yield key, values(key)


_MARKS = re.compile(r"\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[SAYS\]|\[/ROLE\]")


class Reader:
    """Reads turns back from the chunks of one conversation that TURNS has formatted."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = self.mark = self.role = ""

    def add(self, text: str, spans) -> None:
        self.formatted_chars += len(text)
        for s in spans:
            piece = unescape(text[s["start"] : s["end"]])
            self.loss.update(piece.encode())
            self.loss_chars += len(piece)
        text, at = self.rest + text, 0
        for m in _MARKS.finditer(text):
            said, mark = text[at : m.start()], m[0]
            if mark == "[SAYS]":
                self.role = unescape(said)
            elif mark in ("[/INST]", "</s>", "[/ROLE]"):
                role = {"[INST]": "user", "<s>": "assistant"}.get(self.mark, self.role)
                self.turns.update(f"{role}\n{unescape(said)}\n".encode())
                self.n_turns += 1
            self.mark, at = mark, m.end()
        self.rest = text[at:]


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted chunks of TURNS hold, read back from them: a row for each conversation."""
    fields = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        for conv, chunks in _runs((conv, (t, s)) for b in batches for conv, t, s in zip(_keys(b.conv_id), b.text, b.spans, strict=True)):
            r = Reader()
            for text, spans in chunks:
                r.add(text, spans)
            made.append((conv, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars))
            if len(made) >= 4096:
                yield pd.DataFrame(made, columns=["conv_id", *fields]).astype({"conv_id": "Int64"})
                made = []
        if made:
            yield pd.DataFrame(made, columns=["conv_id", *fields]).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
