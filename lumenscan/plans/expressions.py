"""The expression language: a Python-like expression compiled to Columns and plans, and nothing else.

The text is parsed by ``ast`` and walked over an allow-list; types are checked against the schema before any plan
exists, and nothing runs until the result is asked for.  Conditions are two-valued: missing is false, except
that ``!=`` and ``not in`` are true of missing values.
"""

from __future__ import annotations

import ast
import difflib
import itertools
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as S

MOST_CHARS, MOST_NODES, MOST_LITERAL = 2_000, 200, 1_000
LEAST_LIMIT, MOST_LIMIT = 1, 100


class ExpressionError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _invalid(message: str) -> ExpressionError:
    return ExpressionError("INVALID_OPERATION", message)


@dataclass
class Value:
    """A Column with its family: number, text, date, bool or null; scalar if it holds no column."""

    column: Column
    family: str
    scalar: bool = False
    literal: Any = None


@dataclass
class Aggregate:
    value: Column
    by: Column | None
    where: Column | None
    name: str


@dataclass
class Rows:
    columns: list[str]
    where: Column | None
    sort: Column | None
    descending: bool


_NUMBER, _TEXT, _DATE = "number", "text", "date"
_SCALARS = {
    "abs": (_NUMBER, _NUMBER, lambda c: F.abs(c)), "log": (_NUMBER, _NUMBER, S.ln), "log1p": (_NUMBER, _NUMBER, S.log1p), "sqrt": (_NUMBER, _NUMBER, S.sqrt),
    "exp": (_NUMBER, _NUMBER, lambda c: F.exp(c.cast("double"))), "lower": (_TEXT, _TEXT, F.lower), "upper": (_TEXT, _TEXT, F.upper), "strip": (_TEXT, _TEXT, S.strip),
    "length": (_TEXT, _NUMBER, lambda c: F.char_length(c)), "year": (_DATE, _NUMBER, F.year), "month": (_DATE, _NUMBER, F.month), "day": (_DATE, _NUMBER, F.dayofmonth),
    "weekday": (_DATE, _NUMBER, F.weekday), "hour": (_DATE, _NUMBER, F.hour),
}
_TESTS = {"isnull": True, "isna": True, "notnull": False, "notna": False}
_AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "std": F.stddev_samp, "nunique": F.count_distinct,
}
_ARITHMETIC = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: S.safe_divide, ast.FloorDiv: S.floor_divide, ast.Mod: S.floor_mod, ast.Pow: F.pow}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def family_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if S.is_numeric(kind):
        return _NUMBER
    if isinstance(kind, S.TIME_TYPES):
        return _DATE
    return _TEXT if isinstance(kind, T.StringType) else "other"


class Compiler:
    def __init__(self, schema: T.StructType):
        self.schema = {f.name: f.dataType for f in schema}
        self.quoted: dict[str, str] = {}

    def compile(self, text: str) -> Value | Aggregate | Rows:
        if len(text) > MOST_CHARS:
            raise _invalid(f"the expression is longer than {MOST_CHARS} characters")

        def hold(m: re.Match) -> str:
            name = f"quoted_name_{len(self.quoted)}"
            while name in self.schema:
                name += "_"
            self.quoted[name] = m[1]
            return name

        plain = re.sub(r"`([^`]+)`", hold, text.strip())
        try:
            tree = ast.parse(plain, mode="eval")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            raise _invalid("this is no expression") from None
        if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
            raise _invalid(f"the expression has more than {MOST_NODES} parts")
        return self.visit(tree.body, top=True)

    def visit(self, node: ast.AST, top: bool = False) -> Any:
        f = getattr(self, f"visit_{type(node).__name__}", None)
        if f is None:
            raise ExpressionError("OPERATION_REFUSED", f"{type(node).__name__} is not part of the expression language")
        return f(node, top) if isinstance(node, ast.Call) else f(node)

    def value(self, node: ast.AST) -> Value:
        found = self.visit(node)
        if not isinstance(found, Value):
            raise _invalid("an aggregate or rows() stands alone")
        return found

    def visit_Name(self, node: ast.Name) -> Value:
        name = self.quoted.get(node.id, node.id)
        if name.startswith("__"):
            raise ExpressionError("OPERATION_REFUSED", "names with two leading underscores are not allowed")
        if name not in self.schema:
            near = difflib.get_close_matches(name, self.schema, 1)
            raise ExpressionError("COLUMN_NOT_FOUND", f"no column {name}" + (f"; is it {near[0]}?" if near else ""))
        kind = self.schema[name]
        return Value(S.present(F.col(f"`{name}`"), kind), family_of(kind))

    def visit_Constant(self, node: ast.Constant) -> Value:
        x = node.value
        if x is None:
            return Value(F.lit(None), "null", True)
        if isinstance(x, bool):
            return Value(F.lit(x), "bool", True, x)
        if isinstance(x, (int, float)):
            if isinstance(x, int) and abs(x) >= 1 << 63:
                x = float(x) if abs(x) < 10**300 else float("inf")
            return Value(F.lit(x), _NUMBER, True, x)
        if isinstance(x, str):
            if len(x) > MOST_LITERAL:
                raise _invalid(f"a text is longer than {MOST_LITERAL} characters")
            return Value(F.lit(x), _TEXT, True, x)
        raise ExpressionError("OPERATION_REFUSED", "a literal of a kind that is not allowed")

    def mask(self, v: Value) -> Column:
        if v.family not in ("bool", "null"):
            raise _invalid("a condition is needed here")
        return S.yes(v.column.cast("boolean"))

    def number(self, v: Value) -> Column:
        if v.family == "bool":
            return v.column.cast("int")
        if v.family not in (_NUMBER, "null"):
            raise _invalid("a numeric column is needed here")
        return v.column

    def visit_UnaryOp(self, node: ast.UnaryOp) -> Value:
        v = self.value(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return Value(~self.mask(v), "bool", v.scalar)
        c = self.number(v).cast("double") if not v.scalar else self.number(v)
        return Value(-c if isinstance(node.op, ast.USub) else c, _NUMBER, v.scalar, None if v.literal is None else (-v.literal if isinstance(node.op, ast.USub) else v.literal))

    def visit_BoolOp(self, node: ast.BoolOp) -> Value:
        parts = [self.value(v) for v in node.values]
        found = self.mask(parts[0])
        for p in parts[1:]:
            found = (found & self.mask(p)) if isinstance(node.op, ast.And) else (found | self.mask(p))
        return Value(found, "bool", all(p.scalar for p in parts))

    def visit_BinOp(self, node: ast.BinOp) -> Value:
        a, b = self.value(node.left), self.value(node.right)
        scalar = a.scalar and b.scalar
        if isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            x, y = self.mask(a), self.mask(b)
            return Value(x & y if isinstance(node.op, ast.BitAnd) else x | y, "bool", scalar)
        if type(node.op) not in _ARITHMETIC:
            raise ExpressionError("OPERATION_REFUSED", f"{type(node.op).__name__} is not part of the expression language")
        if _TEXT in (a.family, b.family):
            if isinstance(node.op, ast.Add) and a.family == b.family == _TEXT:
                return Value(F.concat(a.column, b.column), _TEXT, scalar)
            raise _invalid("texts can only be added to texts")
        return Value(_ARITHMETIC[type(node.op)](self.number(a).cast("double"), self.number(b).cast("double")), _NUMBER, scalar)

    def visit_Compare(self, node: ast.Compare) -> Value:
        left, found, scalar = self.value(node.left), None, True
        for op, right_node in zip(node.ops, node.comparators, strict=True):
            if isinstance(op, (ast.In, ast.NotIn)):
                one, right = self._in(left, op, right_node), left
            elif type(op) in _COMPARE:
                right = self.value(right_node)
                one = self._compare(left, op, right)
                scalar &= right.scalar
            else:
                raise _invalid("use isnull() or == instead of is")
            found = one if found is None else found & one
            scalar &= left.scalar
            left = right
        return Value(found, "bool", scalar)

    def _compare(self, a: Value, op: ast.cmpop, b: Value) -> Column:
        families = {a.family, b.family} - {"null"}
        x, y = a.column, b.column
        if families == {_DATE, _TEXT}:
            day = a if a.family == _TEXT else b
            if not day.scalar:
                raise _invalid("a date can only be compared with a date or a date's text")
            x, y = (x.cast("timestamp_ntz"), S.parse_date(y)) if b is day else (S.parse_date(x), y.cast("timestamp_ntz"))
        elif families == {_NUMBER, "bool"}:
            x, y = x.cast("double"), y.cast("double")
        elif len(families) > 1:
            raise _invalid(f"{a.family} cannot be compared with {b.family}")
        return F.coalesce(_COMPARE[type(op)](x, y), F.lit(isinstance(op, ast.NotEq)))

    def _in(self, left: Value, op: ast.cmpop, node: ast.AST) -> Column:
        if not isinstance(node, (ast.List, ast.Tuple)):
            raise _invalid("in needs a list of literals")
        items = [self.value(e) for e in node.elts]
        if any(not i.scalar for i in items):
            raise _invalid("in needs a list of literals")
        fits = [i.column for i in items if i.family == left.family or {i.family, left.family} == {_NUMBER, "bool"}]
        found = S.yes(left.column.isin(*fits)) if fits else F.lit(False)
        if left.family == _TEXT and any(i.family == "null" for i in items):
            found = found | left.column.isNull()
        return ~found if isinstance(op, ast.NotIn) else found

    def visit_Call(self, node: ast.Call, top: bool = False) -> Any:
        if not isinstance(node.func, ast.Name):
            raise ExpressionError("OPERATION_REFUSED", "only the functions of the expression language can be called")
        name = node.func.id
        if any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords):
            raise ExpressionError("OPERATION_REFUSED", "star arguments are not allowed")
        known = {k.arg: k.value for k in node.keywords}
        if name in _AGGREGATES or name in ("count", "quantile", "rows"):
            if not top:
                raise _invalid(f"{name}() stands alone; use where= and by=")
            return self._rows(node.args, known) if name == "rows" else self._aggregate(name, node.args, known)
        if name in _TESTS:
            (v,) = self._arguments(name, node.args, known, 1, 1)
            return Value(v.column.isNull() if _TESTS[name] else v.column.isNotNull(), "bool", v.scalar)
        if name == "between":
            v, low, high = self._arguments(name, node.args, known, 3, 3)
            return Value(self._compare(v, ast.GtE(), low) & self._compare(v, ast.LtE(), high), "bool", v.scalar)
        if name == "round":
            v, *digits = self._arguments(name, node.args, known, 1, 2)
            d = digits[0].literal if digits else 0
            if not isinstance(d, int) or abs(d) > 15:
                raise _invalid("round() takes a whole number of digits")
            return Value(F.bround(self.number(v).cast("double"), d), _NUMBER, v.scalar)
        if name in ("contains", "startswith", "endswith"):
            case = known.pop("case", None)
            args = node.args
            if name == "contains" and len(args) == 3:
                case, args = args[2], args[:2]
            v, part = self._arguments(name, args, known, 2, 2)
            if v.family != _TEXT or part.family != _TEXT:
                raise _invalid(f"{name}() needs a text column and a text")
            x, y = v.column, part.column
            if case is not None and isinstance(case, ast.Constant) and case.value is False:
                x, y = F.lower(x), F.lower(y)
            return Value(S.yes(getattr(F, name)(x, y)), "bool", v.scalar)
        if name in _SCALARS:
            needs, gives, f = _SCALARS[name]
            (v,) = self._arguments(name, node.args, known, 1, 1)
            if v.family not in (needs, "null") and not (needs == _NUMBER and v.family == "bool"):
                raise _invalid(f"{name}() needs a {needs} column")
            return Value(f(self.number(v) if needs == _NUMBER else v.column), gives, v.scalar)
        near = difflib.get_close_matches(name, [*_SCALARS, *_AGGREGATES, *_TESTS, "count", "quantile", "rows", "between", "contains", "round"], 1)
        raise _invalid(f"no function {name}()" + (f"; is it {near[0]}()?" if near else ""))

    def _arguments(self, name: str, args: list, known: dict, least: int, most: int) -> list[Value]:
        if known or not least <= len(args) <= most:
            raise _invalid(f"{name}() takes {least} arguments" if least == most else f"{name}() takes {least} to {most} arguments")
        return [self.value(a) for a in args]

    def _aggregate(self, name: str, args: list, known: dict) -> Aggregate:
        where, by = known.pop("where", None), known.pop("by", None)
        q = known.pop("q", None)
        if known:
            raise _invalid(f"{name}() takes where= and by=")
        args = list(args)
        if name == "quantile" and q is None:
            if len(args) != 2:
                raise _invalid("quantile() takes a column and a share")
            q = args.pop()
        if len(args) > 1 or not args and name != "count":
            raise _invalid(f"{name}() takes one column")
        v = self.value(args[0]) if args else None
        if name == "count":
            value = F.count(v.column) if v else F.count(F.lit(1))
        elif name == "quantile":
            share = q.value if isinstance(q, ast.Constant) else None
            if not isinstance(share, (int, float)) or not 0 <= share <= 1:
                raise _invalid("the share of quantile() is between 0 and 1")
            value = F.percentile(self.number(v).cast("double"), float(share))
        elif name in ("min", "max", "nunique"):
            value = _AGGREGATES[name](v.column)
        else:
            value = _AGGREGATES[name](self.number(v).cast("double"))
        group = self.value(by).column if by is not None else None
        return Aggregate(value, group, self.mask(self.value(where)) if where is not None else None, name)

    def _rows(self, args: list, known: dict) -> Rows:
        where, sort, desc = known.pop("where", None), known.pop("sort", None), known.pop("desc", None)
        if known:
            raise _invalid("rows() takes columns, where=, sort= and desc=")
        names = []
        for a in args:
            if not isinstance(a, ast.Name):
                raise _invalid("rows() takes names of columns")
            self.visit_Name(a)
            names.append(self.quoted.get(a.id, a.id))
        descending = isinstance(desc, ast.Constant) and desc.value is True
        return Rows(names or list(self.schema), self.mask(self.value(where)) if where is not None else None, self.value(sort).column if sort is not None else None, descending)


def evaluate(df: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The result as a frame: the matching rows of a condition, the groups of an aggregate, the rows of rows(), or the values of an expression.

    Groups are in falling order of their value, then by key; null keys are left out.  Sorted rows have missing values last.
    """
    if not LEAST_LIMIT <= limit <= MOST_LIMIT:
        raise _invalid(f"the limit is between {LEAST_LIMIT} and {MOST_LIMIT}")
    found = Compiler(df.schema).compile(text)
    if isinstance(found, Aggregate):
        data = df.where(found.where) if found.where is not None else df
        if found.by is None:
            return data.agg(found.value.alias(found.name))
        grouped = data.where(found.by.isNotNull()).groupBy(found.by.alias("key")).agg(found.value.alias(found.name))
        # values without a size come last: missing, then those that are no finite number
        finite = F.abs(F.col(found.name)) < float("inf") if dict(grouped.dtypes)[found.name] in ("double", "float") else F.col(found.name).isNotNull()
        return grouped.orderBy(F.coalesce(finite, F.lit(False)).desc(), F.desc_nulls_last(found.name), F.col("key").cast("string")).limit(limit)
    if isinstance(found, Rows):
        data = df.where(found.where) if found.where is not None else df
        if found.sort is not None:
            at = next(name for name in (f"_at{i}" for i in itertools.count()) if name not in df.columns)  # ties keep the order of the rows
            data = data.withColumn(at, F.monotonically_increasing_id()).orderBy(found.sort.desc_nulls_last() if found.descending else found.sort.asc_nulls_last(), at)
        return data.select(*[F.col(f"`{c}`") for c in found.columns]).limit(limit)
    if found.scalar:
        return df.sparkSession.range(1).select(found.column.alias("value"))
    if found.family == "bool":
        return df.where(found.column).limit(limit)
    return df.select(found.column.alias("value")).limit(limit)


def column(df: DataFrame, text: str) -> Column:
    """The expression as a column of df."""
    found = Compiler(df.schema).compile(text)
    if not isinstance(found, Value):
        raise _invalid("an expression of columns is needed")
    return found.column


def condition(df: DataFrame, text: str) -> Column:
    compiler = Compiler(df.schema)
    found = compiler.compile(text)
    if not isinstance(found, Value):
        raise _invalid("a condition is needed")
    return compiler.mask(found)


def count_matching(df: DataFrame, text: str) -> DataFrame:
    """n_matching and n_rows of a condition."""
    return df.agg(F.count_if(condition(df, text)).alias("n_matching"), F.count(F.lit(1)).alias("n_rows"))


def summary(df: DataFrame, text: str) -> DataFrame:
    """One row of an expression over all rows: n and missing and, of numbers, mean, min, median and max."""
    found = Compiler(df.schema).compile(text)
    if not isinstance(found, Value) or found.scalar:
        raise _invalid("an expression of columns is needed")
    values = df.select(found.column.alias("v"))
    kind = values.schema["v"].dataType
    v = S.present(F.col("v"), kind)
    numbers = [f(v.cast("double")).alias(name) for name, f in (("mean", F.avg), ("min", F.min), ("median", F.median), ("max", F.max))] if S.is_numeric(kind) else []
    return values.agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), *numbers)
