"""Map algebra: one arithmetic expression over co-registered layers.

An expression names layers as ``map1[1]`` (first layer, first band) and uses a
fixed list of functions.  Python's own ``ast`` module reads the text; every
node becomes a Spark column, so Catalyst sees an ordinary projection.
Inside an expression numbers follow IEEE arithmetic and NoData is NaN, so that
a NaN made on the way is NoData too: comparisons with it are false except
``!=``.  Only the stored result turns NaN and infinities into NULL.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Doubles from here on have no fraction.
WHOLE = float(1 << 53)


def _nan() -> Column:
    return F.lit(float("nan"))


def _log(log: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Logarithm that is -inf at zero and NaN below it, where Spark has NULL."""
    return lambda x: F.when(x == 0, float("-inf")).otherwise(F.coalesce(log(x), _nan()))


def _whole(rounding: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Rounding through BIGINT where it is exact; larger values, infinities and NaN stay."""
    return lambda x: F.when(F.abs(x) < WHOLE, rounding(x).cast("double")).otherwise(x)


def _divide(a: Column, b: Column) -> Column:
    """Quotient; over zero it is infinite by the signs of both, or NaN."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def _compare(op: ast.cmpop, a: Column, b: Column) -> Column:
    """Comparison in which NaN differs from everything; Spark sorts it above all numbers."""
    numbers = ~F.isnan(a) & ~F.isnan(b)
    if isinstance(op, ast.NotEq):
        return ~(numbers & (a == b))
    return numbers & COMPARE[type(op)](a, b)


# One-argument functions of the expression language.
UNARY = {
    "ln": _log(F.ln),
    "log10": _log(F.log10),
    "sqrt": F.sqrt,
    "square": lambda x: x * x,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "arcsin": F.asin,
    "arccos": F.acos,
    "arctan": F.atan,
    "abs": F.abs,
    "round_up": _whole(F.ceil),
    "round_down": _whole(F.floor),
}

# Output types, their storage range and their NoData sentinel.
OUTPUT_TYPES = {
    "uint8": ("int", 0, 255, 255.0),
    "int16": ("int", -32768, 32767, -9999.0),
    "int32": ("int", -2147483648, 2147483647, -9999.0),
    "float32": ("float", None, None, -9999.0),
    "float64": ("double", None, None, -9999.0),
}

COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def finite(x: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


class _Translator:
    """Turns expression nodes into columns; predicates are never NULL."""

    def __init__(self, df: DataFrame, layers: Sequence[Sequence[str]]):
        self.df = df
        self.layers = layers

    def number(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id == "no_data":
            return _nan()
        if isinstance(node, ast.Subscript):
            return self.band(node)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            value = self.number(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp) and not isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            return self.arithmetic(node)
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, (ast.Compare, ast.BoolOp, ast.BinOp, ast.UnaryOp)):
            return F.when(self.predicate(node), F.lit(1.0)).otherwise(F.lit(0.0))
        raise ValueError(f"not supported in an expression: {ast.unparse(node)}")

    def band(self, node: ast.Subscript) -> Column:
        name = node.value.id if isinstance(node.value, ast.Name) else ""
        match = re.fullmatch(r"map(\d+)", name)
        if not match or not isinstance(node.slice, ast.Constant):
            raise ValueError("layers are written as mapK[band]")
        layer, band = int(match.group(1)), int(node.slice.value)
        if not (1 <= layer <= len(self.layers) and 1 <= band <= len(self.layers[layer - 1])):
            raise ValueError(f"no such layer band: {name}[{band}]")
        return F.coalesce(F.col(self.layers[layer - 1][band - 1]).cast("double"), _nan())

    def arithmetic(self, node: ast.BinOp) -> Column:
        left, right = self.number(node.left), self.number(node.right)
        if isinstance(node.op, ast.Add):
            return left + right
        if isinstance(node.op, ast.Sub):
            return left - right
        if isinstance(node.op, ast.Mult):
            return left * right
        if isinstance(node.op, ast.Div):
            return _divide(left, right)
        if isinstance(node.op, ast.Pow):
            return F.when(left == 1, 1.0).otherwise(F.pow(left, right))
        raise ValueError(f"operator not supported: {type(node.op).__name__}")

    def call(self, node: ast.Call) -> Column:
        name = node.func.id if isinstance(node.func, ast.Name) else ""
        if name == "where" and len(node.args) == 3:
            test, yes, no = node.args
            return F.when(self.predicate(test), self.number(yes)).otherwise(self.number(no))
        if len(node.args) != 1:
            raise ValueError(f"wrong number of arguments: {name or 'call'}")
        value = self.number(node.args[0])
        if name in ("min", "max"):
            # Whole-layer scalar over the valid pixels, as a scalar subquery.
            reduce = F.min if name == "min" else F.max
            return F.coalesce(self.df.select(reduce(finite(value)).alias("v")).scalar(), _nan())
        if name in UNARY:
            return UNARY[name](value)
        raise ValueError(f"function not supported: {name or 'call'}")

    def predicate(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1 or type(node.ops[0]) not in COMPARE:
                raise ValueError("one comparison at a time")
            return self.comparison(node.left, node.ops[0], node.comparators[0])
        if isinstance(node, ast.BoolOp):
            parts = [self.predicate(v) for v in node.values]
            out = parts[0]
            for part in parts[1:]:
                out = (out & part) if isinstance(node.op, ast.And) else (out | part)
            return out
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            left, right = self.predicate(node.left), self.predicate(node.right)
            return (left & right) if isinstance(node.op, ast.BitAnd) else (left | right)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Invert, ast.Not)):
            return ~self.predicate(node.operand)
        # A bare number is true unless it is zero; NoData counts as non-zero.
        return self.number(node) != 0

    def comparison(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        def is_no_data(n: ast.AST) -> bool:
            return isinstance(n, ast.Name) and n.id == "no_data"

        if is_no_data(left) or is_no_data(right):
            value = self.number(left if is_no_data(right) else right)
            if isinstance(op, ast.Eq):
                return F.isnan(value)
            if isinstance(op, ast.NotEq):
                return ~F.isnan(value)
            raise ValueError("no_data compares with == and != only")
        return _compare(op, self.number(left), self.number(right))


def to_storage(value: Column, dtype: str) -> Column:
    """Cast to an output type, clamped to its range; NaN and infinities become NULL."""
    if dtype not in OUTPUT_TYPES:
        raise ValueError(f"unknown output type: {dtype}")
    spark_type, low, high, _ = OUTPUT_TYPES[dtype]
    clean = finite(value.cast("double"))
    if low is None:
        return clean.cast(spark_type)
    clamped = F.when(clean.isNotNull(), F.greatest(F.least(clean, F.lit(float(high))), F.lit(float(low))))
    # An integer write rounds half away from zero, as a raster writer does.
    return (F.signum(clamped) * F.floor(F.abs(clamped) + 0.5)).cast(spark_type)


def map_algebra(
    df: DataFrame,
    expression: str,
    layers: Sequence[str | Sequence[str]],
    output: str = "value",
    dtype: str = "uint8",
) -> DataFrame:
    """Add ``output`` = ``expression`` over ``layers`` (columns of ``df``)."""
    bands = [[layer] if isinstance(layer, str) else list(layer) for layer in layers]
    text = re.sub(r"\bif\s*\(", "where(", expression.strip())
    node = ast.parse(text, mode="eval").body
    value = _Translator(df, bands).number(node)
    return df.withColumn(output, to_storage(value, dtype))
