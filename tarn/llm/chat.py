"""Chat formatting: a small sandboxed template language, compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import table

# The turn markers, and a template that marks turns and what the loss is taken over.
START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_' + 'start|>' }}{{ message.role | escape_name }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_' + 'end|>' }}\n"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """A template that does not parse, or names something it may not use."""


# ---- control strings -------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    """No control string is left in the result, and ``unescape`` gives the text back: ``\\`` becomes ``\\\\``, ``<|`` ``<\\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_name(text: str) -> str:
    """``escape`` for names, which also end at a line break."""
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


# ---- syntax tree -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "escape_name": lambda v: escape_name(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
}


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _add(a: Any, b: Any) -> Any:
    return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "+": _add,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) else _refuse("%"),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "in": lambda a, b: a in b,
}


def _refuse(what: str) -> Any:
    raise TemplateError(f"not allowed: {what}")


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+%<>()\[\].|]))")
_LITERALS = {"true": True, "false": False, "none": None}
_QUOTED = {"n": "\n", "t": "\t"}


class _Expression:
    """Reads one expression; what binds least is read first."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = _TOKENS.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("text", "number", "name", "sign")[found.lastindex - 1]
            self.tokens.append((kind, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        return found if not found.startswith("_") else _refuse(found)

    def whole(self) -> Any:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> Any:
        left = self.both()
        while self.peek("or"):
            self.at += 1
            left = Binary("or", left, self.both())
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.peek("and"):
            self.at += 1
            left = Binary("and", left, self.negated())
        return left

    def negated(self) -> Any:
        if self.peek("not"):
            self.at += 1
            return Unary("not", self.negated())
        left = self.sum()
        while self.peek("==", "!=", "<", ">", "in"):
            left = Binary(self.take("==", "!=", "<", ">", "in"), left, self.sum())
        return left

    def sum(self) -> Any:
        left = self.filtered()
        while self.peek("+", "-", "%"):
            left = Binary(self.take("+", "-", "%"), left, self.filtered())
        return left

    def filtered(self) -> Any:
        found = self.one()
        while self.peek(".", "[", "|"):
            sign = self.take(".", "[", "|")
            if sign == ".":
                found = Field(found, Const(self.name()))
            elif sign == "[":
                found = Field(found, self.either())
                self.take("]")
            else:
                name = self.name()
                found = Filter(name, found) if name in FILTERS else _refuse(name)
        return found

    def one(self) -> Any:
        if self.peek("("):
            self.at += 1
            found = self.either()
            self.take(")")
            return found
        if self.peek("-"):
            self.at += 1
            return Unary("-", self.one())
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _QUOTED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(value))
        if value in _LITERALS:
            self.at += 1
            return Const(_LITERALS[value])
        return Name(self.name())


def parse(template: str) -> tuple:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at = 0
    for tag in _TAGS.finditer(template):
        parts.append(("text", template[at : tag.start()]))
        if tag[1] is not None:
            parts.append(("output", tag[1]))
        elif tag[2] is not None:
            parts.append(("tag", tag[2].strip()))
        at = tag.end()
    parts.append(("text", template[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes: list[Any] = []
        while place < len(parts):
            kind, body = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Text(body))
            elif kind == "output":
                nodes.append(Output(_Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(nodes), body
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif "):
            other = (branch(end[5:]),)
        elif end == "else":
            other = block("endif")[0]
        return If(_Expression(test).whole(), then, other)

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            return branch(rest)
        if word == "for":
            found = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S) or _refuse(rest)
            return For(found[1], _Expression(found[2]).whole(), block("endfor")[0])
        if word == "set":
            found = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S) or _refuse(rest)
            return Set(found[1], _Expression(found[2]).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        return _refuse(word)

    return block()[0]


def fold(node: Any) -> Any:
    """Compute what does not depend on the conversation: constants, decided branches, neighbouring texts."""
    if isinstance(node, tuple):
        merged: list[Any] = []
        for part in (p for n in node for p in _spread(fold(n))):
            if isinstance(part, Text) and merged and isinstance(merged[-1], Text):
                merged[-1] = Text(merged[-1].value + part.value)
            elif not isinstance(part, Text) or part.value:
                merged.append(part)
        return tuple(merged)
    match node:
        case Unary(op, of):
            of = fold(of)
            return Const(not of.value if op == "not" else -of.value) if isinstance(of, Const) else Unary(op, of)
        case Binary(op, left, right):
            left, right = fold(left), fold(right)
            if op in ("and", "or"):
                if isinstance(left, Const):
                    return right if bool(left.value) == (op == "and") else left
                return Binary(op, left, right)
            if isinstance(left, Const) and isinstance(right, Const):
                return Const(OPERATORS[op](left.value, right.value))
            return Binary(op, left, right)
        case Filter(name, of):
            of = fold(of)
            return Const(FILTERS[name](of.value)) if isinstance(of, Const) else Filter(name, of)
        case Field(of, key):
            return Field(fold(of), fold(key))
        case Output(of):
            of = fold(of)
            return Text(_text(of.value)) if isinstance(of, Const) else Output(of)
        case If(test, then, other):
            test, then, other = fold(test), fold(then), fold(other)
            return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
        case For(name, over, body):
            return For(name, fold(over), fold(body))
        case Set(name, value):
            return Set(name, fold(value))
        case Generation(body):
            return Generation(fold(body))
    return node


def _spread(node: Any) -> tuple:
    return node if isinstance(node, tuple) else (node,)


# ---- closures --------------------------------------------------------------------------------------------------


@dataclass
class _Page:
    """What a rendering has written, its length, and the generated spans."""

    names: dict[str, Any]
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Any) -> Callable[[_Page], Any]:
    """An expression as a closure. Names and fields are looked up in mappings and lists only, never as attributes."""
    match node:
        case Const(value):
            return lambda page: value
        case Name(name):
            return lambda page: page.names.get(name)
        case Field(of, key):
            of, key = _value(of), _value(key)

            def get(page: _Page) -> Any:
                whole, wanted = of(page), key(page)
                if isinstance(whole, dict):
                    return whole.get(wanted)
                if isinstance(whole, (list, tuple)) and isinstance(wanted, int):
                    return whole[wanted] if -len(whole) <= wanted < len(whole) else None
                return None

            return get
        case Unary(op, of):
            of = _value(of)
            return (lambda page: not of(page)) if op == "not" else (lambda page: -of(page))
        case Binary("and", left, right):
            left, right = _value(left), _value(right)
            return lambda page: left(page) and right(page)
        case Binary("or", left, right):
            left, right = _value(left), _value(right)
            return lambda page: left(page) or right(page)
        case Binary(op, left, right):
            left, right, apply = _value(left), _value(right), OPERATORS[op]
            return lambda page: apply(left(page), right(page))
        case Filter(name, of):
            of, apply = _value(of), FILTERS[name]
            return lambda page: apply(of(page))
    raise TemplateError(f"no expression: {node!r}")


def _action(node: Any) -> Callable[[_Page], None]:
    match node:
        case tuple():
            actions = [_action(n) for n in node]

            def run(page: _Page) -> None:
                for action in actions:
                    action(page)

            return run
        case Text(value):
            return lambda page: page.write(value)
        case Output(of):
            of = _value(of)
            return lambda page: page.write(_text(of(page)))
        case Set(name, value):
            value = _value(value)
            return lambda page: page.names.__setitem__(name, value(page))
        case If(test, then, other):
            test, then, other = _value(test), _action(then), _action(other)
            return lambda page: then(page) if test(page) else other(page)
        case For(name, over, body):
            over, body = _value(over), _action(body)

            def loop(page: _Page) -> None:
                items, outer = over(page) or (), dict(page.names)
                for i, item in enumerate(items):
                    page.names[name] = item
                    page.names["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}
                    body(page)
                page.names.clear()
                page.names.update(outer)

            return loop
        case Generation(body):
            body = _action(body)

            def mark(page: _Page) -> None:
                start = page.length
                body(page)
                page.spans.append((start, page.length))

            return mark
    raise TemplateError(f"no statement: {node!r}")


def compile_template(template: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that gives the text and the spans (in code points) of its generated parts."""
    run = _action(fold(parse(template)))

    def render(**names: Any) -> tuple[str, list[tuple[int, int]]]:
        page = _Page(dict(names))
        run(page)
        return "".join(page.parts), page.spans

    return render


# ---- conversations ---------------------------------------------------------------------------------------------



def format_conversations(
    df: DataFrame, template: str = TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its key, ``formatted``, and ``loss_spans``, the generated parts of it in code points.

    Rows are ordered by turn (null first; equal turns by role, then text); null roles and texts are empty. Null keys
    form one conversation; other columns are left out. A conversation is one training text, so its rows
    meet in one task; conversations are spread over all tasks, and only their rows are shuffled.
    """
    compile_template(template)  # a template with errors fails here, not in a task
    grouped = df.groupBy(F.col(conv).alias(conv)).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(turn).isNotNull().alias("dated"),
                    F.col(turn).alias("turn"),
                    F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                )
            )
        ).alias("messages")
    )
    key = grouped.schema[0]
    schema = T.StructType(
        [key, T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.StructType(
            [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    )
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = [run(messages=m) for m in part.column(1).to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, span_type)], names=schema.names
                )

    return grouped.mapInArrow(render, schema)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation that the default template formatted."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts hold, read back from them: turns, and the texts under the loss mask."""
    schema = T.StructType(
        [formatted.schema[conv]]
        + [
            T.StructField(n, t)
            for n, t in (
                ("n_turns", T.LongType()),
                ("turns_sha256", T.StringType()),
                ("loss_chars", T.LongType()),
                ("loss_sha256", T.StringType()),
                ("formatted_chars", T.LongType()),
            )
        ]
    )
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                for column, value in zip(columns, (len(turns), sha(said), len(loss), sha(loss), len(text))):
                    column.append(value)
            arrays = [pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return formatted.select(conv, "formatted", "loss_spans").mapInArrow(read, schema)


def op6_chat_template(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = END + START + "assistant ok"
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return digests(format_conversations(rows.unionByName(probe)))


QUERIES = {"op6_chat_template": op6_chat_template}
ORACLE: dict[str, str] = {}
