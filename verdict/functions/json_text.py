"""JSON as Python spells it, written as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StringType, StructType

from verdict.functions.text import let


def _scientific(x: Column) -> Column:
    """(digits, exponent) of a finite positive number: its shortest decimal digits, of which the first stands before the point."""
    text = x.cast("string")
    whole, part = F.regexp_extract(text, r"^(\d+)\.", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    power = F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    plain = F.struct(F.concat(whole, part).alias("all"), (F.length(whole) - 1 + power).alias("e"))

    def stripped(p: Column) -> Column:
        tail = F.regexp_replace(p["all"], "^0+", "")
        return F.struct(F.regexp_replace(tail, "0+$", "").alias("digits"), (p["e"] - F.length(p["all"]) + F.length(tail)).alias("exponent"))

    def shortest(s: Column) -> Column:
        # The JVM's digits may be one too many; one less that is still the same number is right.
        digits, n = s["digits"], F.length(s["digits"])
        floor = F.substring(digits, F.lit(1), n - 1)
        up = (floor.cast("long") + 1).cast("string")
        told = lambda d: F.concat(d, F.lit("E"), (s["exponent"] - n + 2).cast("string")).cast("double") == x
        high = F.substring(digits, n, F.lit(1)) >= "5"
        fewer = F.when(high & told(up), up).when(told(floor), floor).when(told(up), up)
        better = F.when((n > 1) & fewer.isNotNull(), F.struct(F.regexp_replace(fewer, "0+$", "").alias("digits"), (s["exponent"] + F.length(fewer) - n + 1).alias("exponent")))
        return F.coalesce(better, s)

    return let(let(plain, stripped), shortest)


def _signed(x: Column, body: Column) -> Column:
    negative = (x < 0) | ((x == 0) & x.cast("string").startswith("-"))
    return F.concat(F.when(negative, "-").otherwise(""), body)


def _power(e: Column) -> Column:
    return F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))


def _pointed(digits: Column) -> Column:
    return F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))


def _placed(digits: Column, e: Column, point: str) -> Column:
    """Digits with the point in its place; ``point`` follows whole numbers."""
    n = F.length(digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), e - n + 1), F.lit(point))
    split = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, n))
    return F.when(e >= n - 1, whole).when(e >= 0, split).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))


def python_float(x: Column) -> Column:
    """A double as Python's ``repr`` and ``json`` spell it."""
    x = x.cast("double")

    def body(s: Column) -> Column:
        e = s["exponent"]
        return F.when((e >= -4) & (e < 16), _placed(s["digits"], e, ".0")).otherwise(F.concat(_pointed(s["digits"]), _power(e)))

    finite = _signed(x, F.when(x == 0, "0.0").otherwise(let(_scientific(F.abs(x)), body)))
    return F.when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), _signed(x, F.lit("Infinity"))).otherwise(finite)


def _above_half(x: Column, whole: Column, power: Column) -> Column:
    """The sign of x * 10^power - (whole + 1/2), exactly: the product's rounding error is known from its factors' halves."""
    ten = F.pow(F.lit(10.0), power)
    product = x * ten

    def halves(v: Column) -> tuple[Column, Column]:
        far = v * 134217729.0
        high = far - (far - v)
        return high, v - high

    (a, b), (c, d) = halves(x), halves(ten)
    error = (((a * c - product) + a * d) + b * c) + b * d
    return F.signum((product - (whole + 0.5)) + error)


def general_number(x: Column) -> Column:
    """A number as ``%g`` prints it: six significant digits, rounded from the binary value, half to even."""
    x = x.cast("double")

    def rounded(s: Column) -> Column:
        kept = F.rpad(F.substring(s["digits"], 1, 7), 7, "0").cast("long")
        more, whole, power = F.length(s["digits"]) > 7, F.floor(kept / 10), F.lit(5) - s["exponent"]
        # Seven digits that end in 5 may be short for a little more or less; whole multiples are just that.
        side = F.when(power.between(0, 22), _above_half(F.abs(x), whole, power)).otherwise(0.0)
        up = (kept % 10 > 5) | ((kept % 10 == 5) & (more | (side > 0) | ((side == 0) & (whole % 2 == 1))))
        return F.struct((F.floor(kept / 10) + up.cast("long")).cast("string").alias("all"), s["exponent"].alias("e"))

    def body(r: Column) -> Column:
        e = r["e"] + F.length(r["all"]) - 6
        digits = F.regexp_replace(r["all"], "0+$", "")
        return F.when((e >= -4) & (e < 6), _placed(digits, e, "")).otherwise(F.concat(_pointed(digits), _power(e)))

    finite = _signed(x, F.when(x == 0, "0").otherwise(let(let(_scientific(F.abs(x)), rounded), body)))
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), _signed(x, F.lit("inf"))).otherwise(finite)


def lower_hex(json: Column) -> Column:
    """JSON with small hex digits in the escapes of control characters, where the JVM writes large ones."""
    parts = F.regexp_extract_all(json, F.lit(r"\\u[0-9A-Fa-f]{4}|\\.|[^\\]+"), F.lit(0))
    return F.when(json.contains("\\u"), F.array_join(F.transform(parts, lambda t: F.when(t.startswith("\\u"), F.lower(t)).otherwise(t)), "")).otherwise(json)


def json_string(text: Column) -> Column:
    """A text as a JSON string: only quotes, backslashes and control characters are escaped, with small hex digits."""
    quoted = F.to_json(F.array(text))
    return lower_hex(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def canonical_json(value: Column, kind: DataType) -> Column:
    """A typed value as JSON with sorted keys and without blanks; nulls are spelled out."""
    if isinstance(kind, StructType):
        fields = sorted(kind, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'{"," if k else ""}"{f.name}":'), canonical_json(value[f.name], f.dataType)) for k, f in enumerate(fields)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StringType):
        text = json_string(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        text = python_float(value)
    else:
        text = F.lower(value.cast("string")) if isinstance(kind, BooleanType) else value.cast("string")
    return F.when(value.isNull(), "null").otherwise(text)
