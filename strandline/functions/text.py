"""Number formats of the text sinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import col


SPLIT = 134217729.0  # 2**27 + 1, which halves the digits of a double


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * SPLIT - (x * SPLIT - x)
    return high, x - high


POWERS = 15


POWERS = 15


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(x: Column | str, digits: int | Column) -> Column:
    """``x`` with ``digits`` decimals (0 to ``POWERS``), rounded by its exact binary value, ties to even. For |x| * 10**digits below 2**53."""
    digits = F.lit(digits) if isinstance(digits, int) else digits
    powers = F.array(*[F.struct(F.lit(float(10**k)).alias("scale"), F.lit(10**k).cast("long").alias("base")) for k in range(POWERS + 1)])
    given = F.struct(col(x).cast("double").alias("x"), digits.alias("digits"), F.element_at(powers, digits + 1).alias("power"))

    def rounded(v: Column) -> Column:
        size, scale = F.abs(v["x"]), v["power"]["scale"]
        return _let(F.struct(size.alias("size"), scale.alias("scale"), (size * scale).alias("product")), whole)

    def whole(v: Column) -> Column:
        (xh, xl), (sh, sl) = _halves(v["size"]), _halves(v["scale"])
        rest = ((xh * sh - v["product"]) + xh * sl + xl * sh) + xl * sl  # what the product lost
        floor = F.floor(v["product"])
        over = (v["product"] - floor.cast("double")) - 0.5
        return floor + F.when((over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (floor % 2 == 1)))), 1).otherwise(0)

    def text(v: Column) -> Column:
        base = v["power"]["base"]
        sign = F.when(v["x"] < 0, "-").otherwise("")
        point = lambda n: F.concat(sign, F.floor(n / base).cast("string"), F.when(v["digits"] > 0, F.concat(F.lit("."), F.lpad((n % base).cast("string"), v["digits"], F.lit("0")))).otherwise(""))
        return _let(rounded(v), point)

    return _let(given, text)


def _trimmed(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _power(x: Column) -> Column:
    return F.floor(F.log10(F.abs(x))).cast("int")


def general6(x: Column | str) -> Column:
    """Six significant digits like C's %g: scientific below 1e-4 and from 1e6, zeros trimmed."""

    def text(v: Column) -> Column:
        x, power = v["x"], v["power"]
        common = power.between(-4, 5)
        digits = _trimmed(fixed(F.when(common, x).otherwise(x / F.pow(F.lit(10.0), power)), F.when(common, 5 - power).otherwise(5)))
        exponent = F.concat(F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        return F.when(x == 0, F.lit("0")).otherwise(F.concat(digits, F.when(common, "").otherwise(exponent)))

    x = col(x).cast("double")
    return _let(F.struct(x.alias("x"), _power(x).alias("power")), text)


def plain6(x: Column | str) -> Column:
    """Six significant digits, never scientific (at most ``POWERS`` decimals)."""
    x = col(x).cast("double")
    return F.when(x == 0, F.lit("0")).otherwise(_trimmed(fixed(x, F.least(F.greatest(5 - _power(x), F.lit(0)), F.lit(POWERS)))))


def single7(x: Column | str, y: Column | str) -> Column:
    """x / y in single precision with seven decimals; 0.0000000 if y is 0."""
    x, y = col(x), col(y)
    quotient = (x.cast("float") / F.when(y != 0, y).cast("float")).cast("float")
    return fixed(F.coalesce(quotient.cast("double"), F.lit(0.0)), 7)


def number(x: Column | str) -> Column:
    """A number as text: no point in whole numbers, no exponent in others of common size."""
    x = col(x).cast("double")
    tiny = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"0+$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e18), F.format_string("%d", x.cast("bigint"))).when(F.abs(x) < 1e-3, tiny).when(F.abs(x) >= 1e7, F.regexp_replace(x.cast("decimal(38,8)").cast("string"), r"0+$", "")).otherwise(x.cast("string"))


def parse_size(text: str) -> int:
    """``1K``, ``5M``, ``2G`` or a plain number."""
    t = text.strip().upper()
    scale = {"K": 10**3, "M": 10**6, "G": 10**9, "B": 10**9}.get(t[-1:], 1)
    number = t[:-1] if scale > 1 else t
    try:
        value = float(number) * scale
    except ValueError:
        raise ValueError(f"not a size: {text!r}") from None
    if value < 0:
        raise ValueError(f"not a size: {text!r}")
    return int(value)
