"""Text templates that become native column expressions.

The subset that prompts use: `{{ value }}`, `{% if %}` with `elif` and `else`, `{% for x in list %}`, `{% set x = value %}`,
comments, and a dash that trims white space on its side of a tag. Values are names, fields, places and slices,
numbers, texts, sums and comparisons, `and`, `or`, `not`, and the filters length, upper, lower, trim, join and default. A template is
read once, when the query is built; a name or field that is not there raises then.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, NumericType, StringType, StructType

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.S)
_WORDS = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\|)|(\*\*)""")


class TemplateError(ValueError):
    """A template that cannot be read, or names what is not there."""


class Value(NamedTuple):
    """A column and its type, None where that is a number of whatever kind."""

    column: Column
    kind: DataType | None


Names = dict[str, Value]


def _parsed(source: str) -> ast.expr:
    """A value's syntax. A filter's bar binds closer than any operator, as a power does, so it is read as one."""

    def bar(m: re.Match) -> str:
        if m[3]:
            raise TemplateError(f"** is not of the subset: {source}")
        return m[1] or " ** "

    try:
        return ast.parse(_WORDS.sub(bar, source.strip()), mode="eval").body
    except SyntaxError as e:
        raise TemplateError(f"cannot read {source!r}") from e


def _truth(v: Value) -> Column:
    """Whether a value counts as true: not null, not 0, not empty."""
    if isinstance(v.kind, BooleanType):
        found = v.column
    elif isinstance(v.kind, StringType):
        found = v.column != ""
    elif isinstance(v.kind, ArrayType):
        found = F.size(v.column) > 0
    elif isinstance(v.kind, StructType):
        found = v.column.isNotNull()
    else:
        found = v.column != 0
    return F.coalesce(found, F.lit(False))


def _text(v: Value) -> Column:
    """A value as it is shown: None, True and False by name."""
    if isinstance(v.kind, BooleanType):
        return F.when(v.column, "True").when(~v.column, "False").otherwise("None")
    return F.coalesce(v.column.cast("string"), F.lit("None"))


def _length(v: Value) -> Value:
    return Value(F.size(v.column) if isinstance(v.kind, ArrayType) else F.length(v.column), IntegerType())


def _filtered(v: Value, name: str, args: list[Value]) -> Value:
    plain = {"upper": F.upper, "lower": F.lower, "trim": lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")}
    if name == "length" and not args:
        return _length(v)
    if name in plain and not args:
        return Value(plain[name](v.column), StringType())
    if name == "join" and len(args) <= 1 and isinstance(v.kind, ArrayType):
        parts = F.transform(v.column, lambda x: _text(Value(x, v.kind.elementType)))
        return Value(F.call_function("concat_ws", args[0].column if args else F.lit(""), parts), StringType())
    if name == "default" and len(args) == 1:
        return Value(F.coalesce(v.column, args[0].column), v.kind)
    raise TemplateError(f"no filter {name} of {len(args)} arguments for this value")


def _slice(v: Value, low: int | None, high: int | None) -> Value:
    """value[low:high] of a text or list, negatives from the end."""
    n = _length(v).column
    place = lambda k, other: other if k is None else F.least(F.lit(k), n) if k >= 0 else F.greatest(n + k, F.lit(0))
    a, b = place(low, F.lit(0)), place(high, n)
    size = F.greatest(b - a, F.lit(0))
    return Value(F.slice(v.column, a + 1, size) if isinstance(v.kind, ArrayType) else F.substr(v.column, a + 1, size), v.kind)


def _whole(node: ast.expr | None) -> int | None:
    if node is None:
        return None
    try:
        k = ast.literal_eval(node)
    except ValueError:
        k = None
    if type(k) is not int:
        raise TemplateError("places and slices are whole numbers")
    return k


_COMPARED = {ast.Eq: lambda a, b: a.eqNullSafe(b), ast.NotEq: lambda a, b: ~a.eqNullSafe(b), ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_COMBINED = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a.cast("double") / b, ast.Mod: lambda a, b: F.pmod(a, b)}


def _value(node: ast.expr, names: Names) -> Value:
    if isinstance(node, ast.Constant):
        kind = {str: StringType(), int: IntegerType(), bool: BooleanType(), float: None}.get(type(node.value), "none")
        if kind != "none":
            return Value(F.lit(node.value), kind)
    if isinstance(node, ast.Name):
        if node.id in ("true", "false"):
            return Value(F.lit(node.id == "true"), BooleanType())
        if node.id not in names:
            raise TemplateError(f"{node.id} is undefined")
        return names[node.id]
    if isinstance(node, ast.Attribute) or isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, str):
        of, field = _value(node.value, names), node.attr if isinstance(node, ast.Attribute) else node.slice.value
        if not isinstance(of.kind, StructType) or field not in of.kind.names:
            raise TemplateError(f"{field} is undefined")
        return Value(of.column[field], of.kind[field].dataType)
    if isinstance(node, ast.Subscript):
        of = _value(node.value, names)
        if isinstance(node.slice, ast.Slice) and node.slice.step is None:
            return _slice(of, _whole(node.slice.lower), _whole(node.slice.upper))
        k = _whole(node.slice)
        if isinstance(of.kind, ArrayType):
            return Value(F.try_element_at(of.column, F.lit(k + 1 if k >= 0 else k)), of.kind.elementType)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
        used, rest = node.right, None
        if isinstance(used, ast.BinOp) and isinstance(used.op, ast.Pow):  # x | f | g is read from the right
            used, rest = used.left, used.right
        name, args = (used.func, used.args) if isinstance(used, ast.Call) and not used.keywords else (used, [])
        if not isinstance(name, ast.Name):
            raise TemplateError("a filter has a name")
        found = _filtered(_value(node.left, names), name.id, [_value(a, names) for a in args])
        return found if rest is None else _value(ast.BinOp(ast.Name("_filtered"), ast.Pow(), rest), {**names, "_filtered": found})
    if isinstance(node, ast.BinOp) and type(node.op) in _COMBINED:
        a, b = _value(node.left, names), _value(node.right, names)
        if isinstance(node.op, ast.Add) and isinstance(a.kind, StringType):
            return Value(F.concat(a.column, b.column), StringType())
        return Value(_COMBINED[type(node.op)](a.column, b.column), None)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return Value(-_value(node.operand, names).column, None)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return Value(~_truth(_value(node.operand, names)), BooleanType())
    if isinstance(node, ast.BoolOp):
        parts = [_truth(_value(v, names)) for v in node.values]
        found = parts[0]
        for p in parts[1:]:
            found = found & p if isinstance(node.op, ast.And) else found | p
        return Value(found, BooleanType())
    if isinstance(node, ast.Compare) and all(type(op) in _COMPARED for op in node.ops):
        sides, found = [_value(v, names).column for v in (node.left, *node.comparators)], F.lit(True)
        for a, op, b in zip(sides, node.ops, sides[1:]):
            found = found & _COMPARED[type(op)](a, b)
        return Value(found, BooleanType())
    raise TemplateError(f"not of the subset: {ast.dump(node)[:80]}")


def _pieces(template: str) -> list[str]:
    """Texts and tags in turn, with the white space gone that dashes trim, without comments and one last line end."""
    parts = _TAG.split(template.removesuffix("\n"))
    for k in range(1, len(parts), 2):
        if not parts[k].startswith("{#"):
            if parts[k][2] == "-":
                parts[k - 1] = parts[k - 1].rstrip()
            if parts[k][-3] == "-":
                parts[k + 1] = parts[k + 1].lstrip()
    if any(mark in text for text in parts[::2] for mark in ("{{", "{%", "{#")):
        raise TemplateError("a tag is not closed")
    return [p for p in parts if p and not p.startswith("{#")]


def _body(pieces: list[str], at: int, names: Names, until: tuple[str, ...]) -> tuple[Column, int, str]:
    """The text of pieces from `at` on up to a tag of `until`, the place behind that tag, and the tag's words."""
    names, out = dict(names), [F.lit("")]
    while at < len(pieces):
        piece = pieces[at]
        at += 1
        if piece.startswith("{{"):
            out.append(_text(_value(_parsed(piece[2:-2].strip("-")), names)))
        elif not piece.startswith("{%"):
            out.append(F.lit(piece))
        else:
            tag = piece[2:-2].strip("-").strip()
            word, _, rest = tag.partition(" ")
            if word in until:
                return F.concat(*out), at, tag
            if word == "if":
                found, cases = None, []
                while word in ("if", "elif"):
                    condition = _truth(_value(_parsed(rest), names))
                    text, at, tag = _body(pieces, at, names, ("elif", "else", "endif"))
                    cases.append((condition, text))
                    word, _, rest = tag.partition(" ")
                other = F.lit("")
                if word == "else":
                    other, at, _ = _body(pieces, at, names, ("endif",))
                for condition, text in cases:
                    found = F.when(condition, text) if found is None else found.when(condition, text)
                out.append(found.otherwise(other))
            elif word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)
                over = _value(_parsed(m[2]), names) if m else None
                if over is None or not isinstance(over.kind, ArrayType):
                    raise TemplateError(f"no list to go over: {tag}")
                each, ends = _each(pieces, at, names, m[1], over.kind.elementType)
                out.append(F.array_join(F.transform(F.coalesce(over.column, F.array().cast(over.kind)), each), ""))
                at = ends[-1]
            elif word == "set" and (m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)):
                names[m[1]] = _value(_parsed(m[2]), names)
            else:
                raise TemplateError(f"not of the subset: {piece}")
    if until:
        raise TemplateError(f"no {until[-1]}")
    return F.concat(*out), at, ""


def _each(pieces: list[str], at: int, names: Names, name: str, kind: DataType) -> tuple[Callable[[Column, Column], Column], list[int]]:
    """A loop's body for an element and its place; the places behind its end go to the list."""
    ends: list[int] = []
    loop = StructType().add("index", IntegerType()).add("index0", IntegerType())

    def each(x: Column, i: Column) -> Column:
        inner = {**names, name: Value(x, kind), "loop": Value(F.struct((i + 1).alias("index"), i.alias("index0")), loop)}
        text, end, _ = _body(pieces, at, inner, ("endfor",))
        ends.append(end)
        return text

    return each, ends


def template(rows: DataFrame, source: str, **values: Column | str | int | float | bool) -> Column:
    """The text of a template for each of rows: names are the rows' columns, and values (columns or constants) that come before them.

    A name that is set within an `if` or `for` holds there only. A null is shown as None and counts as false.
    """
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    kinds = rows.select("*", *[v.alias(f"{k} given") for k, v in given.items()]).schema
    kind = lambda t: None if isinstance(t, NumericType) and not isinstance(t, IntegerType) else t
    names = {f.name: Value(F.col(f"`{f.name}`"), kind(f.dataType)) for f in rows.schema.fields}
    names |= {k: Value(v, kind(kinds[f"{k} given"].dataType)) for k, v in given.items()}
    return _body(_pieces(source), 0, names, ())[0]
