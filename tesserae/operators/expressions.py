"""The formula language and expression trees, compiled to columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import regex, replacement
from ..relation import PlanError, col, is_number, kind, need, new_name, operation, refuse, text_of

TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|`([^`]+)`|([^\W\d]\w*)|(.))", re.S)
MOST_NODES, MOST_DEPTH = 4096, 64


@dataclass(frozen=True)
class Typed:
    column: Column
    #: number, text, boolean, date, timestamp or null
    kind: str
    constant: object = None


def finite(c: Column) -> Column:
    return refuse(F.isnan(c) | (F.abs(c) == float("inf")), "evaluation.non_finite", c)


def quotient(a: Column, b: Column) -> Column:
    return finite(refuse(b == 0, "evaluation.division_by_zero", F.try_divide(a, b)))


def ieee_quotient(a: Column, b: Column) -> Column:
    """Of doubles: infinite or not a number where b is 0."""
    sign = F.signum(a) * F.when(b.cast("string") == "-0.0", F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(b == 0, F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).otherwise(sign * F.lit(math.inf))).otherwise(F.try_divide(a, b))


class Formula:
    """A recursive-descent parser of + - * / and parentheses; + joins texts."""

    def __init__(self, df: DataFrame, text: str):
        self.df, self.tokens = df, [m.groups() for m in TOKEN.finditer(text.strip())]
        self.at = 0
        if len(self.tokens) > MOST_NODES:
            raise PlanError("the formula is too long")

    def peek(self) -> str | None:
        return self.tokens[self.at][5] if self.at < len(self.tokens) else None

    def parse(self) -> Typed:
        out = self.sum(0)
        if self.at != len(self.tokens):
            raise PlanError("the formula can't be read to its end")
        return out

    def sum(self, depth: int) -> Typed:
        if depth > MOST_DEPTH:
            raise PlanError("the formula is nested too deeply")
        out = self.product(depth)
        while (sign := self.peek()) in ("+", "-"):
            self.at += 1
            other = self.product(depth)
            if sign == "+" and "text" in (out.kind, other.kind):
                out = Typed(F.concat(self.text(out), self.text(other)), "text")
            else:
                self.numbers(out, other)
                out = Typed(finite(out.column + other.column if sign == "+" else out.column - other.column), "number")
        return out

    def product(self, depth: int) -> Typed:
        out = self.unary(depth)
        while (sign := self.peek()) in ("*", "/"):
            self.at += 1
            other = self.unary(depth)
            self.numbers(out, other)
            out = Typed(finite(out.column * other.column) if sign == "*" else quotient(out.column, other.column), "number")
        return out

    def unary(self, depth: int) -> Typed:
        if self.peek() == "-":
            self.at += 1
            x = self.unary(depth + 1)
            self.numbers(x)
            return Typed(-x.column, "number")
        if self.at >= len(self.tokens):
            raise PlanError("the formula ends too early")
        digits, double, single, quoted, name, sign = self.tokens[self.at]
        self.at += 1
        if digits is not None:
            return Typed(F.lit(float(digits)), "number")
        if double is not None or single is not None:
            return Typed(F.lit(re.sub(r"\\(.)", r"\1", double if double is not None else single)), "text")
        if quoted is not None or name is not None:
            return field(self.df, quoted or name)
        if sign == "(":
            out = self.sum(depth + 1)
            if self.peek() != ")":
                raise PlanError("a parenthesis is not closed")
            self.at += 1
            return out
        raise PlanError(f"{sign!r} is not expected in a formula")

    @staticmethod
    def numbers(*xs: Typed) -> None:
        if any(x.kind != "number" for x in xs):
            raise PlanError("a number is needed")

    def text(self, x: Typed) -> Column:
        return text_of(x.column, T.DoubleType()) if x.kind == "number" else x.column


def field(df: DataFrame, name: str) -> Typed:
    t = kind(df, name)
    if is_number(t):
        return Typed(col(name).cast("double"), "number")
    if isinstance(t, T.BooleanType):
        return Typed(col(name), "boolean")
    if isinstance(t, T.DateType):
        return Typed(col(name), "date")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Typed(col(name), "timestamp")
    return Typed(text_of(col(name), t), "text")


@operation("table.formula")
def formula(df: DataFrame, new_column: str, formula: str) -> DataFrame:
    return df.withColumn(new_name(new_column), Formula(df, formula).parse().column)


class Compiler:
    """Expression trees: {column}, {literal}, {unary, operand}, {binary, left, right}, {function, arguments}, {case, else}."""

    def __init__(self, df: DataFrame, keep: bool = False):
        """keep: results that are infinite or not a number are values and not errors."""
        self.df, self.nodes = df, 0
        self.finite, self.quotient = (lambda c: c, ieee_quotient) if keep else (finite, quotient)
        self.keep = keep

    def build(self, e: dict, depth: int = 1) -> Typed:
        self.nodes += 1
        if depth > MOST_DEPTH or self.nodes > MOST_NODES:
            raise PlanError("the expression is too large")
        if "column" in e:
            need(self.df, e["column"])
            return field(self.df, e["column"])
        if "literal" in e:
            return constant(e["literal"])
        sub = lambda x: self.build(x, depth + 1)
        if "unary" in e:
            return self.unary(e["unary"], sub(e["operand"]))
        if "binary" in e:
            return self.binary(e["binary"], sub(e["left"]), sub(e["right"]))
        if "function" in e:
            return self.function(e["function"], [sub(a) for a in e.get("arguments", [])])
        if "case" in e:
            branches = [(sub(b["when"]), sub(b["then"])) for b in e["case"]]
            if not 1 <= len(branches) <= MOST_DEPTH:
                raise PlanError("a case has 1 to 64 branches")
            last = sub(e["else"]) if e.get("else") is not None else Typed(F.lit(None), "null")
            kinds = {t.kind for _, t in branches} | {last.kind}
            kinds.discard("null")
            if len(kinds) > 1 or any(w.kind not in ("boolean", "null") for w, _ in branches):
                raise PlanError("the branches of a case differ in type")
            out = None
            for w, t in branches:
                out = F.when(w.column, t.column) if out is None else out.when(w.column, t.column)
            return Typed(out.otherwise(last.column), kinds.pop() if kinds else "null")
        raise PlanError("an expression has no known form")

    def unary(self, op: str, x: Typed) -> Typed:
        if op == "not":
            return Typed(~only(x, "boolean"), "boolean")
        if op == "negate":
            return Typed(-only(x, "number"), "number")
        if op in ("is_null", "is_not_null"):
            return Typed(x.column.isNull() if op == "is_null" else x.column.isNotNull(), "boolean")
        raise PlanError(f"there is no operator {op!r}")

    def binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("and", "or"):
            x, y = only(a, "boolean"), only(b, "boolean")
            return Typed(x & y if op == "and" else x | y, "boolean")
        if op in ("add", "subtract", "multiply", "divide"):
            x, y = only(a, "number"), only(b, "number")
            if op == "divide":
                if b.constant == 0 and not self.keep:
                    raise PlanError("division by the literal 0")
                return Typed(self.quotient(x, y), "number")
            return Typed(self.finite({"add": x + y, "subtract": x - y, "multiply": x * y}[op]), "number")
        if "null" not in (a.kind, b.kind) and a.kind != b.kind:
            raise PlanError("values of different types are compared")
        x, y = a.column, b.column
        table = {"equal": lambda: x == y, "not_equal": lambda: x != y, "greater": lambda: x > y, "greater_equal": lambda: x >= y, "less": lambda: x < y, "less_equal": lambda: x <= y}
        if op not in table:
            raise PlanError(f"there is no operator {op!r}")
        return Typed(table[op](), "boolean")

    def function(self, name: str, a: list[Typed]) -> Typed:
        n = lambda k: only(a[k], "number")
        t = lambda k: only(a[k], "text")
        arity = {"year": (1, 1), "lower": (1, 1), "upper": (1, 1), "trim": (1, 1), "length": (1, 1), "abs": (1, 1), "floor": (1, 1), "ceil": (1, 1), "round": (1, 2), "power": (2, 2), "substring": (2, 3), "regex_replace": (3, 3), "between": (3, 3), "null_if": (2, 2), "contains": (2, 2), "starts_with": (2, 2), "ends_with": (2, 2), "date_trunc": (2, 2), "in": (1, MOST_NODES), "coalesce": (1, MOST_NODES), "concat": (1, MOST_NODES), "greatest": (1, MOST_NODES), "least": (1, MOST_NODES)}
        if name not in arity:
            raise PlanError(f"there is no function {name!r}")
        if not arity[name][0] <= len(a) <= arity[name][1]:
            raise PlanError(f"{name} has too few or too many arguments")
        if name in ("lower", "upper"):
            return Typed((F.lower if name == "lower" else F.upper)(t(0)), "text")
        if name == "trim":
            return Typed(F.regexp_replace(t(0), r"^\s+|\s+$", ""), "text")
        if name == "length":
            return Typed(F.char_length(t(0)).cast("double"), "number")
        if name == "year":
            at = F.try_to_timestamp(F.left(t(0), F.lit(10)), F.lit("yyyy-MM-dd")) if a[0].kind == "text" else a[0].column
            return Typed(F.year(refuse(a[0].column.isNotNull() & at.isNull(), "conversion.invalid_datetime", at)).cast("double"), "number")
        if name == "coalesce":
            kinds = {x.kind for x in a} - {"null"}
            if len(kinds) > 1:
                raise PlanError("the arguments differ in type")
            return Typed(F.coalesce(*[x.column for x in a]), kinds.pop() if kinds else "null")
        if name == "null_if":
            return Typed(F.when(~F.coalesce(a[0].column == a[1].column, F.lit(False)), a[0].column), a[0].kind)
        if name == "concat":
            return Typed(F.concat(*[t(k) for k in range(len(a))]), "text")
        if name in ("contains", "starts_with", "ends_with"):
            return Typed({"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}[name](t(0), t(1)), "boolean")
        if name in ("abs", "floor", "ceil"):
            return Typed({"abs": F.abs, "floor": F.floor, "ceil": F.ceil}[name](n(0)).cast("double"), "number")
        if name == "round":
            digits = int(a[1].constant) if len(a) > 1 and a[1].constant is not None else 0
            return Typed(F.round(n(0), digits), "number")
        if name == "power":
            return Typed(self.finite(F.pow(n(0), n(1))), "number")
        if name == "substring":
            start = refuse(n(1) < 0, "evaluation.negative_position", n(1)).cast("int") + 1
            size = refuse(n(2) < 0, "evaluation.negative_length", n(2)).cast("int") if len(a) > 2 else F.lit(2**31 - 1)
            return Typed(F.substr(t(0), start, size), "text")
        if name == "regex_replace":
            if a[1].constant is None or a[2].constant is None:
                raise PlanError("pattern and replacement are literals")
            return Typed(F.regexp_replace(t(0), regex(a[1].constant), replacement(a[2].constant)), "text")
        if name == "between":
            return Typed((a[0].column >= a[1].column) & (a[0].column <= a[2].column), "boolean")
        if name == "in":
            values = [x.constant for x in a[1:] if x.constant is not None]
            return Typed(F.when(a[0].column.isNotNull(), a[0].column.isin(values) if values else F.lit(False)), "boolean")
        if name in ("greatest", "least"):
            any_null = a[0].column.isNull()
            for x in a[1:]:
                any_null |= x.column.isNull()
            best = (F.greatest if name == "greatest" else F.least)(*[x.column for x in a]) if len(a) > 1 else a[0].column
            return Typed(F.when(~any_null, best), a[0].kind)
        unit = a[0].constant
        if a[1].kind not in ("date", "timestamp") or unit not in ("year", "month", "day", "hour", "minute", "second") or a[1].kind == "date" and unit in ("hour", "minute", "second"):
            raise PlanError("date_trunc can't cut this")
        return Typed(F.date_trunc(unit, a[1].column).cast("date" if a[1].kind == "date" else "timestamp_ntz"), a[1].kind)


def only(x: Typed, want: str) -> Column:
    if x.kind not in (want, "null"):
        raise PlanError(f"{want} is needed, not {x.kind}")
    return x.column.cast({"number": "double", "text": "string", "boolean": "boolean"}[want]) if x.kind == "null" else x.column


def constant(v: object) -> Typed:
    if v is None:
        return Typed(F.lit(None), "null")
    if isinstance(v, bool):
        return Typed(F.lit(v), "boolean", v)
    if isinstance(v, (int, float)):
        if not math.isfinite(v):
            raise PlanError("a literal is not finite")
        return Typed(F.lit(float(v)), "number", float(v))
    return Typed(F.lit(v), "text", v)


@operation("table.expression")
def expression(df: DataFrame, output_column: str, expression: dict, output_type: str = "auto", non_finite: str = "reject") -> DataFrame:
    """non_finite: "keep" computes as IEEE 754 says, so that a division by 0 is infinite or not a number; else it ends the query."""
    if non_finite not in ("reject", "keep"):
        raise PlanError(f"results that are not finite can't be treated by {non_finite!r}")
    out = Compiler(df, non_finite == "keep").build(expression)
    casts = {"auto": None, "number": "double", "boolean": "boolean", "text": "string", "date32": "date", "timestamp_ms": "timestamp_ntz"}
    if output_type not in casts:
        raise PlanError(f"there is no type {output_type!r}")
    want = {"number": "number", "boolean": "boolean", "text": "text", "date32": "date", "timestamp_ms": "timestamp"}.get(output_type)
    if want and out.kind not in (want, "null"):
        raise PlanError(f"the expression gives {out.kind}, not {want}")
    c = out.column.cast(casts[output_type]) if casts[output_type] else out.column.cast("double") if out.kind == "null" else out.column
    return df.withColumn(new_name(output_column), c)
