"""A small formula language, compiled to one native column.

Formulas are written in the expression syntax of Python (column names, literals, arithmetic,
comparisons, and / or / not, calls of the functions below) and become Spark expressions, so that the
optimizer sees them and no row passes through Python. Names that are no identifiers stand between
backticks. Anything else of the language is refused before a column is built.

Missing values: arithmetic gives missing; comparisons give False (`!=` True); text tests give False.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import col, is_date, is_number, number, timestamp

# The limits of a formula.
MAX_NODES = 250
MAX_TEXT = 500


class FormulaError(ValueError):
    """The formula is not allowed, or does not fit the table."""


@dataclass(frozen=True)
class Value:
    """A compiled part: its column, its type (None: a bare null), and its Python value if it is a literal."""

    column: Column
    type: T.DataType | None
    literal: object = None
    constant: bool = False

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)


NUMBER, TEXT, BOOL, TIME = T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _number(v: Value) -> Column:
    return F.lit(None).cast("double") if v.type is None else number(v.column, v.type)


def _time(v: Value) -> Column:
    return F.lit(None).cast("timestamp") if v.type is None else timestamp(v.column, v.type)


def _text(v: Value) -> Column:
    return v.column.cast("string")


def _bool(v: Value) -> Column:
    if not v.is_bool:
        raise FormulaError("and, or, not and conditions take true-or-false values")
    return F.coalesce(v.column, F.lit(False))


def _literal_text(v: Value) -> str:
    if not v.constant or not isinstance(v.literal, str):
        raise FormulaError("a text literal is needed here")
    return v.literal


def _common(values: list[Value]) -> T.DataType:
    """The type that all of the values share, missing literals apart."""
    types = [v.type for v in values if v.type is not None]
    if not types:
        return TEXT
    if all(is_number(t) and not isinstance(t, T.BooleanType) for t in types):
        return NUMBER
    if all(is_date(t) for t in types):
        return TIME
    if all(type(t) is type(types[0]) for t in types):
        return types[0]
    raise FormulaError("the values are of different types")


def _as(v: Value, t: T.DataType) -> Column:
    return F.lit(None).cast(t) if v.type is None else (_number(v) if t == NUMBER else v.column.cast(t))


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder that has the divisor's sign; null if the divisor is zero."""
    return a - F.floor(F.try_divide(a, b)) * b


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _period(c: Column, how: str) -> Column:
    if how == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return F.date_format(c, how)


def bucket(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed bin that holds the value; the lowest edge belongs to the first bin."""
    if len(edges) < 2 or len(labels) != len(edges) - 1 or any(a >= b for a, b in zip(edges, edges[1:])):
        raise FormulaError("bucket takes rising edges and one label fewer than edges")
    out = F.lit(None).cast("string")
    for low, high, name in reversed(list(zip(edges, edges[1:], labels))):
        above = value >= low if low == edges[0] else value > low
        out = F.when(above & (value <= high), F.lit(str(name))).otherwise(out)
    return out


# Divisors of a difference in microseconds, by unit.
_UNITS = {"days": 86_400e6, "hours": 3_600e6, "minutes": 60e6, "months": 30.4375 * 86_400e6, "years": 365.25 * 86_400e6}


def date_diff(a: Column, b: Column, unit: str) -> Column:
    """a - b; whole days are rounded down, other units are fractional."""
    if unit not in _UNITS:
        raise FormulaError(f"date_diff has no unit {unit}")
    elapsed = (F.unix_micros(a) - F.unix_micros(b)) / F.lit(_UNITS[unit])
    return F.floor(elapsed).cast("double") if unit == "days" else elapsed


class _Compiler:
    def __init__(self, df: DataFrame, names: dict[str, str], as_of: str | None):
        self.schema = {f.name: f.dataType for f in df.schema}
        self.names, self.as_of = names, as_of

    def build(self, node: ast.AST) -> Value:
        how = getattr(self, f"on_{type(node).__name__}", None)
        if how is None:
            raise FormulaError(f"{type(node).__name__} is not allowed in a formula")
        return how(node)

    def on_Expression(self, node):
        return self.build(node.body)

    def on_Name(self, node):
        name = self.names.get(node.id, node.id)
        if name.startswith("__"):
            raise FormulaError("names that begin with __ are not allowed")
        if name not in self.schema:
            raise FormulaError(f"unknown column {name}")
        return Value(col(name), self.schema[name])

    def on_Constant(self, node):
        v = node.value
        if v is None:
            return Value(F.lit(None), None, None, True)
        if isinstance(v, str) and len(v) > MAX_TEXT:
            raise FormulaError("a text is too long")
        kinds = {bool: BOOL, int: NUMBER, float: NUMBER, str: TEXT}
        if type(v) not in kinds:
            raise FormulaError("only numbers, texts, True, False and None are literals")
        return Value(F.lit(float(v)) if type(v) is int else F.lit(v), kinds[type(v)], v, True)

    def on_UnaryOp(self, node):
        v = self.build(node.operand)
        if isinstance(node.op, ast.Not):
            return Value(~_bool(v), BOOL)
        if isinstance(node.op, ast.USub):
            if v.constant and isinstance(v.literal, (int, float)):
                return Value(F.lit(-float(v.literal)), NUMBER, -v.literal, True)
            return Value(-_number(v), NUMBER)
        if isinstance(node.op, ast.UAdd):
            return Value(_number(v), NUMBER)
        raise FormulaError("only not, - and + stand before a value")

    def on_BoolOp(self, node):
        parts = [_bool(self.build(v)) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return Value(out, BOOL)

    def on_BinOp(self, node):
        a, b = self.build(node.left), self.build(node.right)
        if isinstance(node.op, ast.Add):
            if a.is_text and b.is_text:
                return Value(F.concat(a.column, b.column), TEXT)
            if a.is_text or b.is_text:
                raise FormulaError("+ takes two numbers or two texts")
        x, y = _number(a), _number(b)
        made = {
            ast.Add: lambda: x + y,
            ast.Sub: lambda: x - y,
            ast.Mult: lambda: x * y,
            ast.Div: lambda: F.try_divide(x, y),
            ast.FloorDiv: lambda: F.floor(F.try_divide(x, y)).cast("double"),
            ast.Mod: lambda: floor_mod(x, y),
            ast.Pow: lambda: finite(F.pow(x, y)),
        }.get(type(node.op))
        if made is None:
            raise FormulaError(f"{type(node.op).__name__} is not an operator of formulas")
        return Value(made(), NUMBER)

    def on_Compare(self, node):
        tests = {ast.Eq: Column.__eq__, ast.NotEq: Column.__ne__, ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__}
        sides = [self.build(n) for n in (node.left, *node.comparators)]
        out = F.lit(True)
        for op, a, b in zip(node.ops, sides, sides[1:]):
            if type(op) not in tests:
                raise FormulaError(f"{type(op).__name__} is not a comparison of formulas")
            t = TIME if any(v.type is not None and is_date(v.type) for v in (a, b)) else _common([a, b])
            x, y = (_time(a), _time(b)) if t == TIME else (_as(a, t), _as(b, t))
            out = out & F.coalesce(tests[type(op)](x, y), F.lit(isinstance(op, ast.NotEq)))
        return Value(out, BOOL)

    def on_Call(self, node):
        if not isinstance(node.func, ast.Name) or node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise FormulaError("only plain calls of the formula functions are allowed")
        name = node.func.id.removeprefix(_MARK)
        if name == "bucket":
            return self.bucket(node.args)
        rule = FUNCTIONS.get(name)
        if rule is None:
            raise FormulaError(f"unknown function {name}")
        low, high, make = rule
        if not low <= len(node.args) <= high:
            raise FormulaError(f"{name} takes {low} to {high} values")
        args = [self.build(a) for a in node.args]
        return make(self, *args)

    def bucket(self, args):
        if len(args) != 3 or not all(isinstance(a, ast.List) for a in args[1:]):
            raise FormulaError("bucket takes a value, a list of edges and a list of labels")
        edges, labels = ([self.build(e) for e in a.elts] for a in args[1:])
        if not all(v.constant for v in (*edges, *labels)) or not all(isinstance(v.literal, (int, float)) for v in edges):
            raise FormulaError("edges and labels of bucket are literals")
        return Value(bucket(_number(self.build(args[0])), [float(v.literal) for v in edges], [v.literal for v in labels]), TEXT)


def _part(make: Callable[[Column], Column], t: T.DataType):
    return 1, 1, lambda _, v: Value(make(_time(v)).cast(t), t)


def _concat(_, *values: Value) -> Value:
    """A third or later literal at the end is the separator; missing parts are empty and keep it."""
    sep = ""
    if len(values) >= 3 and values[-1].constant:
        *values, last = values
        sep = "" if last.literal is None else str(last.literal)
    parts = [F.coalesce(_text(v), F.lit("")) for v in values]
    return Value(F.concat(*[x for p in parts for x in (F.lit(sep), p)][1:]), TEXT)


def _either(_, test: Value, yes: Value, no: Value) -> Value:
    t = _common([yes, no])
    return Value(F.when(_bool(test), _as(yes, t)).otherwise(_as(no, t)), t)


def _first(_, *values: Value) -> Value:
    t = _common(list(values))
    return Value(F.coalesce(*[_as(v, t) for v in values]), t)


def _round(_, v: Value, places: Value | None = None) -> Value:
    n = 0 if places is None else places.literal
    if places is not None and not (places.constant and isinstance(n, int)):
        raise FormulaError("round takes a whole number of places")
    return Value(F.bround(_number(v), n), NUMBER)


#: name -> (least and most values, how the column is made)
FUNCTIONS: dict[str, tuple[int, int, Callable[..., Value]]] = {
    "year": _part(F.year, NUMBER), "day": _part(F.dayofmonth, NUMBER), "hour": _part(F.hour, NUMBER), "minute": _part(F.minute, NUMBER), "week": _part(F.weekofyear, NUMBER),
    "quarter": _part(lambda c: _period(c, "quarter"), TEXT), "month": _part(lambda c: _period(c, "yyyy-MM"), TEXT), "dayofweek": _part(lambda c: _period(c, "EEEE"), TEXT),
    "is_weekend": (1, 1, lambda _, v: Value(F.coalesce(F.weekday(_time(v)) >= 5, F.lit(False)), BOOL)),
    "today": (0, 0, lambda self: Value(F.lit(self.as_of) if self.as_of else F.current_date().cast("string"), TEXT)),
    "date_diff": (2, 3, lambda _, a, b, unit=None: Value(date_diff(_time(a), _time(b), "days" if unit is None else _literal_text(unit)), NUMBER)),
    "lower": (1, 1, lambda _, v: Value(F.lower(_text(v)), TEXT)),
    "upper": (1, 1, lambda _, v: Value(F.upper(_text(v)), TEXT)),
    "length": (1, 1, lambda _, v: Value(F.length(_text(v)).cast("double"), NUMBER)),
    "contains": (2, 2, lambda _, v, x: Value(F.coalesce(F.lower(_text(v)).contains(_literal_text(x).lower()), F.lit(False)), BOOL)),
    "startswith": (2, 2, lambda _, v, x: Value(F.coalesce(_text(v).startswith(_literal_text(x)), F.lit(False)), BOOL)),
    "endswith": (2, 2, lambda _, v, x: Value(F.coalesce(_text(v).endswith(_literal_text(x)), F.lit(False)), BOOL)),
    "concat": (2, 99, _concat),
    "if": (3, 3, _either),
    "coalesce": (2, 99, _first),
    "isnull": (1, 1, lambda _, v: Value(F.lit(True) if v.type is None else v.column.isNull(), BOOL)),
    "abs": (1, 1, lambda _, v: Value(F.abs(_number(v)), NUMBER)),
    "round": (1, 2, _round),
    "min": (2, 99, lambda _, *v: Value(F.least(*map(_number, v)), NUMBER)),
    "max": (2, 99, lambda _, *v: Value(F.greatest(*map(_number, v)), NUMBER)),
    "log": (1, 1, lambda _, v: Value(F.when(_number(v) > 0, F.log(_number(v))), NUMBER)),
    "sqrt": (1, 1, lambda _, v: Value(F.when(_number(v) >= 0, F.sqrt(_number(v))), NUMBER)),
}

_MARK = "call_of_"


#: A text literal, a name between backticks, or a backtick without another.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`([^`]*)`|`""", re.S)


def _prepared(formula: str, taken: set[str]) -> tuple[str, dict[str, str]]:
    """The formula with `if(` and names between backticks made parseable, and what the made-up names, none of which is taken, stand for."""
    names: dict[str, str] = {}

    def named(m: re.Match) -> str:
        if not m[0].startswith("`"):
            return m[0]
        if m[1] is None:
            raise FormulaError("a backtick is left open")
        name = f"column_{len(names)}_"
        while name in taken or name in formula:
            name += "_"
        names[name] = m[1]
        return name

    plain = _QUOTED.sub(named, formula).strip()
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(plain).readline))
    except (tokenize.TokenError, SyntaxError) as e:
        raise FormulaError(f"the formula cannot be read: {e}") from None
    out = [(t.type, f"{_MARK}if" if t.type == tokenize.NAME and t.string == "if" and n.string == "(" else t.string) for t, n in zip(tokens, [*tokens[1:], tokens[-1]])]
    return tokenize.untokenize(out).strip(), names


def compile_formula(df: DataFrame, formula: str, as_of: str | None = None) -> Value:
    """The formula as a column of df, with its type; FormulaError if it is not allowed or does not fit."""
    if not isinstance(formula, str) or not formula.strip():
        raise FormulaError("a formula is a text that is not empty")
    plain, names = _prepared(formula, set(df.columns))
    try:
        tree = ast.parse(plain, mode="eval")
    except (SyntaxError, ValueError) as e:
        raise FormulaError(f"the formula cannot be read: {e}") from None
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise FormulaError("the formula is too large")
    return _Compiler(df, names, as_of).build(tree)


def derive(df: DataFrame, name: str, formula: str, as_of: str | None = None) -> DataFrame:
    """df with one more column; a literal result is the same in every row."""
    made = compile_formula(df, formula, as_of)
    return df.withColumn(name, made.column.cast("string") if made.type is None else made.column)


def check_formula(df: DataFrame, formula: str) -> str | None:
    """What is wrong with the formula for this table, None if nothing: it is analysed, and no row is read."""
    try:
        df.select(compile_formula(df, formula).column).schema
    except FormulaError as e:
        return str(e)
    except Exception as e:  # analysis errors
        return str(e).splitlines()[0]
    return None
