"""A small predicate language, compiled to columns.

`and`, `or`, `not`, chains of comparisons, `in`, `is`, signs, lists, attribute access and the functions below. Null
ordering is false, equality is null-safe, operands count by their truth: numbers other than 0, filled strings and arrays.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 500
_no = lambda c: F.coalesce(c, F.lit(False))


class Term(NamedTuple):
    """A value, its kind, where it can't be worked out, and where it is there but isn't of its kind (and so null)."""

    value: Column
    kind: str
    fails: Column
    odd: Column


def _term(value: Column, kind: str, fails: Column | None = None, odd: Column | None = None) -> Term:
    return Term(value, kind, F.lit(False) if fails is None else fails, F.lit(False) if odd is None else odd)


def _of_kind(x: Term, *kinds: str) -> Column:
    """Where x is no value of the kinds."""
    return x.value.isNull() if x.kind in kinds else F.lit(True)


def _number(x: Term, kind: str) -> Term:
    cast = F.lit(None).cast(kind) if x.kind in ("null", "array") else x.value.try_cast(kind)
    return _term(cast, "number", x.fails | cast.isNull())


def _sized(x: Term) -> Term:
    size = F.length(x.value) if x.kind == "string" else F.size(x.value) if x.kind == "array" else F.lit(None).cast("int")
    return _term(size, "number", x.fails | _of_kind(x, "string", "array"))


FUNCTIONS = {
    "len": _sized,
    "lower": lambda x: _term(F.lower(x.value), "string", x.fails),
    "upper": lambda x: _term(F.upper(x.value), "string", x.fails),
    "exists": lambda x: _term(x.value.isNotNull() | x.odd, "boolean", x.fails),
    "int": lambda x: _number(x, "long"),
    "float": lambda x: _number(x, "double"),
    "str": lambda x: _term(x.value.cast("string"), "string", x.fails),
    "abs": lambda x: _term(F.abs(x.value) if x.kind == "number" else F.lit(None).cast("double"), "number", x.fails | _of_kind(x, "number")),
}
PAIRS = {"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}


class PredicateError(ValueError):
    pass


def compile_predicate(text: str, columns: Mapping[str, tuple]) -> Column:
    """A boolean column, never null; false where it can't be worked out. columns: name to (column, kind of number, string, boolean or array
    and, if wanted, where a value is there that isn't of that kind); others are null. Kinds that can't be ordered are an error.
    """
    return _compiled(text, columns, True)[0]


def checked_predicate(text: str, columns: Mapping[str, tuple]) -> tuple[Column, Column]:
    """(a boolean column, where it can't be worked out: numbers of texts that are none, lengths of what isn't there, orders of unlike kinds).

    What `and`, `or` and chains of comparisons don't need to look at can't fail. Both are never null; where it fails, it is false.
    """
    return _compiled(text, columns, False)


def _compiled(text: str, columns: Mapping[str, tuple], strict: bool) -> tuple[Column, Column]:
    if len(text) > MAX_LENGTH:
        raise PredicateError(f"longer than {MAX_LENGTH} characters")
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as error:
        raise PredicateError(str(error)) from error
    whole = _value(tree, columns, strict)
    fails = _no(whole.fails)
    return _truth(whole) & ~fails, fails


def _truth(x: Term) -> Column:
    """Whether a value counts as true; one that isn't of its kind is a filled text."""
    if x.kind == "null":
        return F.lit(False)
    return _no({"boolean": lambda: x.value, "number": lambda: x.value != 0, "string": lambda: x.value != "", "array": lambda: F.size(x.value) > 0}[x.kind]()) | x.odd


def _name(node: ast.expr) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}"
    if isinstance(node, ast.Name):
        return node.id
    raise PredicateError(f"not a name: {ast.dump(node)}")


def _value(node: ast.expr, columns, strict: bool) -> Term:
    if isinstance(node, ast.Constant):
        kind = "null" if node.value is None else "boolean" if isinstance(node.value, bool) else "number" if isinstance(node.value, int | float) else "string"
        return _term(F.lit(node.value), kind)
    if isinstance(node, ast.Name | ast.Attribute):
        column, kind, *odd = columns.get(_name(node), (F.lit(None), "null"))
        return _term(column, kind, None, _no(odd[0]) if odd else None)
    if isinstance(node, ast.List | ast.Tuple):
        listed = [_value(x, columns, strict) for x in node.elts]
        return _term(F.array(*[x.value for x in listed]), "array", reduce(or_, [x.fails for x in listed], F.lit(False)))
    if isinstance(node, ast.UnaryOp):
        x = _value(node.operand, columns, strict)
        if isinstance(node.op, ast.Not):
            return _term(~_truth(x), "boolean", x.fails)
        signed = x.value if x.kind == "number" else F.lit(None).cast("double")
        return _term(-signed if isinstance(node.op, ast.USub) else signed, "number", x.fails | _of_kind(x, "number"))
    if isinstance(node, ast.BoolOp):
        both = isinstance(node.op, ast.And)
        out, fails = F.lit(both), F.lit(False)
        for x in (_value(v, columns, strict) for v in node.values):
            fails = fails | ((out if both else ~out) & _no(x.fails))
            out = out & _truth(x) if both else out | _truth(x)
        return _term(out, "boolean", fails)
    if isinstance(node, ast.Compare):
        left = _value(node.left, columns, strict)
        out, fails = F.lit(True), _no(left.fails)
        for op, x in zip(node.ops, node.comparators):
            right = _value(x, columns, strict)
            same, unlike = _compared(op, left, right, strict)
            fails = fails | (out & (_no(right.fails) | _no(unlike)))
            out, left = out & same, right
        return _term(out, "boolean", fails)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        given = [_value(x, columns, strict) for x in node.args]
        if node.func.id in FUNCTIONS and len(given) == 1:
            return FUNCTIONS[node.func.id](given[0])
        fails = reduce(or_, [x.fails for x in given], F.lit(False))
        if node.func.id in PAIRS and len(given) == 2:
            return _term(_no(PAIRS[node.func.id](given[0].value, given[1].value)), "boolean", fails)
        if node.func.id in ("min", "max") and len(given) > 1:
            none = reduce(or_, [x.value.isNull() for x in given])
            return _term((F.least if node.func.id == "min" else F.greatest)(*[x.value for x in given]), "number", fails | none)
    raise PredicateError(f"not allowed: {ast.unparse(node)}")


def _compared(op: ast.cmpop, left: Term, right: Term, strict: bool) -> tuple[Column, Column]:
    """(whether a comparison holds, where its sides have no order)."""
    a, ka, b, kb = left.value, left.kind, right.value, right.kind
    if isinstance(op, ast.Eq | ast.Is | ast.NotEq | ast.IsNot):
        same = F.lit(False) if "null" not in (ka, kb) and ka != kb else a.eqNullSafe(b) & ~left.odd & ~right.odd
        return (same if isinstance(op, ast.Eq | ast.Is) else ~same), F.lit(False)
    if isinstance(op, ast.In | ast.NotIn):
        inside = F.lit(False) if "null" in (ka, kb) else _no(F.contains(b, a) if kb == "string" else F.array_contains(b, a))
        return (inside if isinstance(op, ast.In) else ~inside), F.lit(False)
    there = (a.isNotNull() | left.odd) & (b.isNotNull() | right.odd)
    if "null" in (ka, kb):
        return F.lit(False), F.lit(False)
    if ka != kb:
        if strict:
            raise PredicateError(f"can't order {ka} and {kb}")
        return F.lit(False), there
    return _no({ast.Lt: a < b, ast.LtE: a <= b, ast.Gt: a > b, ast.GtE: a >= b}[type(op)]), there & (left.odd | right.odd)
