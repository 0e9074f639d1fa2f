"""Conditions over spans and span events, compiled to Spark columns or evaluated on Python rows.

The language is the subset of the telemetry transformation language that
sampling conditions use: comparisons, ``and``, ``or``, ``not``, parentheses,
literals, paths (``attributes["k"]``, ``resource.attributes["k"]``, ``name``,
``status.code`` and others) and a few converters.

A missing attribute is nil.  ``nil != "v"`` holds, ``nil == nil`` holds, and an
order comparison with nil or between types doesn't hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import is_root


class ConditionError(ValueError):
    """A condition that can't be parsed."""


TOKENS = re.compile(
    r"""\s*(?:(?P<str>"(?:\\.|[^"\\])*")|(?P<num>-?[0-9]+(?:\.[0-9]+)?)|(?P<op>==|!=|<=|>=|<|>)|(?P<punct>[()\[\],.])|(?P<word>[A-Za-z_][A-Za-z0-9_]*))"""
)
#: Enumerated names and the status that they stand for.  Fixed values.
ENUMS = {"STATUS_CODE_UNSET": "UNSET", "STATUS_CODE_OK": "OK", "STATUS_CODE_ERROR": "ERROR"}
SPAN_PATHS = {"name": "name", "trace_id.string": "trace_id", "span_id.string": "span_id", "parent_span_id.string": "parent_span_id", "start_time_unix_nano": "start_ns", "end_time_unix_nano": "end_ns", "status.code": "status"}
NUMBERS = ("start_ns", "end_ns")
CONVERTERS = {"IsRootSpan": 0, "IsMatch": 2, "IsString": 1, "IsBool": 1, "IsInt": 1, "IsDouble": 1, "Len": 1, "ToLowerCase": 1, "ToUpperCase": 1, "HasPrefix": 2, "HasSuffix": 2}


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    args: tuple[Node, ...] = ()


class Parser:
    def __init__(self, text: str, context: str):
        self.text, self.context = text, context
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = TOKENS.match(text, at)
            if not m:
                raise ConditionError(f"can't read {text[at:]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None) -> bool:
        return self.at < len(self.tokens) and (value is None or self.tokens[self.at][1] == value)

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.peek(value):
            raise ConditionError(f"expected {value or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Node:
        out = self.either()
        if self.at < len(self.tokens):
            raise ConditionError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek("or"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", args=tuple(parts))

    def both(self) -> Node:
        parts = [self.negation()]
        while self.peek("and"):
            self.take()
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else Node("and", args=tuple(parts))

    def negation(self) -> Node:
        if self.peek("not"):
            self.take()
            return Node("not", args=(self.negation(),))
        if self.peek("("):
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        left = self.operand()
        if self.peek() and self.tokens[self.at][0] == "op":
            op = self.take()[1]
            return Node("compare", op, (left, self.operand()))
        if left.kind == "call" and (left.value.startswith("Is") or left.value.startswith("Has")) or left.kind == "lit" and isinstance(left.value, bool):
            return left
        raise ConditionError(f"not a condition: {self.text!r}")

    def operand(self) -> Node:
        kind, text = self.take()
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", r"\1", text[1:-1]))
        if kind == "num":
            return Node("lit", float(text) if "." in text else int(text))
        if kind != "word":
            raise ConditionError(f"unexpected {text!r} in {self.text!r}")
        if text in ("true", "false"):
            return Node("lit", text == "true")
        if text == "nil":
            return Node("lit", None)
        if text in ENUMS:
            return Node("lit", ENUMS[text])
        if self.peek("("):
            return self.call(text)
        path = [text]
        while self.peek("."):
            self.take()
            path.append(self.take()[1])
        if path[0] == "span" and self.context == "event" and len(path) > 1:
            return self.path(path[1:], "span")
        if path[0] == self.context.replace("event", "spanevent") and len(path) > 1:
            path = path[1:]
        return self.path(path, self.context)

    def path(self, path: list[str], context: str) -> Node:
        name = ".".join(path)
        if name in ("attributes", "resource.attributes"):
            self.take("[")
            kind, key = self.take()
            self.take("]")
            if kind != "str":
                raise ConditionError(f"expected a key in {self.text!r}")
            return Node("attr", ("resource" if name[0] == "r" else context, re.sub(r"\\(.)", r"\1", key[1:-1])))
        if context == "event" and name == "name" or context == "span" and name in SPAN_PATHS:
            return Node("path", (context, SPAN_PATHS[name]))
        raise ConditionError(f"unknown path {name!r} in {self.text!r}")

    def call(self, name: str) -> Node:
        if name not in CONVERTERS or name == "IsRootSpan" and self.context != "span":
            raise ConditionError(f"unknown function {name!r} in {self.text!r}")
        self.take("(")
        args: list[Node] = []
        while not self.peek(")"):
            if args:
                self.take(",")
            args.append(self.operand())
        self.take(")")
        if len(args) != CONVERTERS[name]:
            raise ConditionError(f"{name} takes {CONVERTERS[name]} arguments in {self.text!r}")
        if name == "IsMatch":
            if args[1].kind != "lit" or not isinstance(args[1].value, str):
                raise ConditionError(f"IsMatch needs a literal pattern in {self.text!r}")
            try:
                re.compile(args[1].value)
            except re.error as e:
                raise ConditionError(f"{args[1].value!r} isn't a regular expression: {e}") from None
        return Node("call", name, tuple(args))


def parse(text: str, context: str = "span") -> Node:
    """A condition in the context of a ``span`` or an ``event`` (of a span)."""
    return Parser(text, context).parse()


# --- Spark ---------------------------------------------------------------


def _typed(node: Node, row: Callable[[str], Column], event: Column | None) -> dict[str, Column]:
    """A value by type: columns for s, b, i, d and j, of which at most one isn't null."""
    null = {"s": F.lit(None).cast("string"), "b": F.lit(None).cast("boolean"), "i": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "j": F.lit(None).cast("string")}
    if node.kind == "lit":
        v = node.value
        kind = "b" if isinstance(v, bool) else "i" if isinstance(v, int) else "d" if isinstance(v, float) else "s"
        return null if v is None else null | {kind: F.lit(v)}
    if node.kind == "path":
        where, name = node.value
        value = event["name"] if where == "event" else row(name)
        return null | {"i" if name in NUMBERS else "s": value}
    if node.kind == "attr":
        where, key = node.value
        attrs = event["attrs"] if where == "event" else row("resource_attrs" if where == "resource" else "attrs")
        value = F.try_element_at(attrs, F.lit(key))
        return {k: value[k] for k in null}
    name, args = node.value, [_typed(a, row, event) for a in node.args]
    if name == "Len":
        return null | {"i": F.length(args[0]["s"]).cast("long")}
    if name in ("ToLowerCase", "ToUpperCase"):
        return null | {"s": (F.lower if name == "ToLowerCase" else F.upper)(args[0]["s"])}
    return null | {"b": _truth(node, row, event)}


def _truth(node: Node, row: Callable[[str], Column], event: Column | None) -> Column:
    if node.kind == "lit":
        return F.lit(bool(node.value))
    if node.kind == "not":
        return ~_truth(node.args[0], row, event)
    if node.kind in ("and", "or"):
        out = _truth(node.args[0], row, event)
        for a in node.args[1:]:
            b = _truth(a, row, event)
            out = out & b if node.kind == "and" else out | b
        return out
    if node.kind == "call":
        if node.value == "IsRootSpan":
            return is_root(row("trace_id"), row("parent_span_id"))
        value = _typed(node.args[0], row, event)
        if node.value in ("IsString", "IsBool", "IsInt", "IsDouble"):
            return value[{"IsString": "s", "IsBool": "b", "IsInt": "i", "IsDouble": "d"}[node.value]].isNotNull()
        text = F.coalesce(value["s"], value["b"].cast("string"), value["i"].cast("string"), value["d"].cast("string"), value["j"])
        if node.value == "IsMatch":
            return F.coalesce(text.rlike(node.args[1].value), F.lit(False))
        part = _typed(node.args[1], row, event)["s"]
        return F.coalesce(value["s"].startswith(part) if node.value == "HasPrefix" else value["s"].endswith(part), F.lit(False))
    left, right = (_typed(a, row, event) for a in node.args)
    number = lambda t: F.coalesce(t["d"], t["i"].cast("double"))
    if node.value in ("==", "!="):
        same = F.lit(True)
        for k in ("s", "b", "j"):
            same = same & left[k].eqNullSafe(right[k])
        both_whole = left["i"].isNotNull() & right["i"].isNotNull()
        same = same & F.when(both_whole, left["i"] == right["i"]).otherwise(number(left).eqNullSafe(number(right)))
        return same if node.value == "==" else ~same
    order = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[node.value]
    whole = order(left["i"], right["i"])
    return F.coalesce(whole, order(number(left), number(right)), order(left["s"], right["s"]), F.lit(False))


def to_column(nodes: list[Node], event: Column | None = None, row: Callable[[str], Column] = F.col) -> Column:
    """Whether any of the conditions holds for a span row, or for ``event`` of it."""
    out = F.lit(False)
    for n in nodes:
        out = out | _truth(n, row, event)
    return out


# --- Python --------------------------------------------------------------


def _plain(value: Any) -> Any:
    """An attribute struct as a Python value."""
    if value is None:
        return None
    get = value.get if isinstance(value, dict) else lambda k: value[k]
    return next((get(k) for k in ("s", "b", "i", "d", "j") if get(k) is not None), None)


def value_of(node: Node, span: dict, event: dict | None = None) -> Any:
    if node.kind == "lit":
        return node.value
    if node.kind == "path":
        where, name = node.value
        return event["name"] if where == "event" else span[name]
    if node.kind == "attr":
        where, key = node.value
        attrs = event["attrs"] if where == "event" else span["resource_attrs" if where == "resource" else "attrs"]
        return _plain((attrs or {}).get(key))
    if node.value in ("Len", "ToLowerCase", "ToUpperCase"):
        v = value_of(node.args[0], span, event)
        if not isinstance(v, str):
            return None
        return len(v) if node.value == "Len" else v.lower() if node.value == "ToLowerCase" else v.upper()
    return holds(node, span, event)


def holds(node: Node, span: dict, event: dict | None = None) -> bool:
    """Whether a condition holds for a span, or for one of its events."""
    if node.kind == "lit":
        return bool(node.value)
    if node.kind == "not":
        return not holds(node.args[0], span, event)
    if node.kind == "and":
        return all(holds(a, span, event) for a in node.args)
    if node.kind == "or":
        return any(holds(a, span, event) for a in node.args)
    if node.kind == "call":
        if node.value == "IsRootSpan":
            parent = span["parent_span_id"] or "0" * 16
            return parent == "0" * 16 or parent == span["trace_id"][16:32]
        v = value_of(node.args[0], span, event)
        kind = {"IsString": str, "IsBool": bool, "IsDouble": float}.get(node.value)
        if kind:
            return isinstance(v, kind)
        if node.value == "IsInt":
            return isinstance(v, int) and not isinstance(v, bool)
        if node.value == "IsMatch":
            return v is not None and re.search(node.args[1].value, str(v).lower() if isinstance(v, bool) else str(v)) is not None
        part = value_of(node.args[1], span, event)
        return isinstance(v, str) and isinstance(part, str) and (v.startswith(part) if node.value == "HasPrefix" else v.endswith(part))
    a, b = (value_of(x, span, event) for x in node.args)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    alike = number(a) and number(b) or type(a) is type(b)
    if node.value == "==":
        return alike and a == b
    if node.value == "!=":
        return not (alike and a == b)
    if not (number(a) and number(b) or isinstance(a, str) and isinstance(b, str)):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.value]
