"""Values of JSON whose kind differs from row to row, told and spelled by column expressions.

A value is held as VARIANT, which tells its kind and its parts, and as text, which keeps the order of keys and the spelling
of numbers that a VARIANT loses. Texts are spelled anew token by token, as Python spells what it has read.

Limits: what a VARIANT can't hold (some 128 MB, objects that repeat a key, NaN) is no JSON here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdict.functions.json_text import json_string, python_float
from verdict.functions.text import let

TOKEN = r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+'
#: Marks a number that must keep its spelling while a VARIANT sorts the keys around it.
MARK = "\ue000"
REAL = r"^-?[0-9].*[.eE]"


def _value(v: Column, text: Column) -> Column:
    """``kind`` is OBJECT, ARRAY, STRING, BOOLEAN or VOID; numbers are BIGINT, DECIMAL or DOUBLE; null if there is no value."""
    return F.struct(v.alias("v"), text.alias("text"), F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).alias("kind"))


def value(text: Column) -> Column:
    """A JSON text as a value, of kind null if it is none. Strings lose their quotes."""
    whole = F.struct(F.try_parse_json(text).alias("v"), text.alias("text"))

    def told(x: Column) -> Column:
        return _value(x["v"], F.when(F.schema_of_variant(x["v"]) == "STRING", F.try_variant_get(x["v"], "$", "string")).otherwise(x["text"]))

    return let(whole, told)


def strings(texts: Column) -> Column:
    """Texts as values."""
    return F.transform(texts, lambda t: F.struct(F.lit(None).cast("variant").alias("v"), t.alias("text"), F.lit("STRING").alias("kind")))


def field(x: Column, name: str) -> Column:
    """A field of an object, as a value; without it, null all through."""
    return _value(F.try_variant_get(x["v"], f"$.{name}", "variant"), F.from_json(x["text"], f"`{name}` string")[name])


def items(x: Column) -> Column:
    """The items of an array as values; null if it is none."""
    parts, texts = F.try_variant_get(x["v"], "$", "array<variant>"), F.from_json(x["text"], "array<string>")
    return F.when(x["kind"] == "ARRAY", F.zip_with(parts, texts, _value))


def truthy(x: Column) -> Column:
    """What Python takes for true: not null, false, zero or empty."""
    told, bare = x["kind"], F.regexp_replace(x["text"], r"\s", "")
    some = F.when(told == "BOOLEAN", bare == "true").when(told == "STRING", x["text"] != "").when(told.isin("ARRAY", "OBJECT"), ~bare.isin("[]", "{}")).otherwise(x["text"].try_cast("double") != 0)
    return F.coalesce((told != "VOID") & some, F.lit(False))


def _spelled(text: Column, gaps: tuple[str, str], words: dict[str, str], string: Callable[[Column], Column], marked: bool = False) -> Column:
    """JSON text token by token: blanks behind commas and colons, words, strings; real numbers as Python has them."""

    def token(t: Column) -> Column:
        real = python_float(t.cast("double"))
        out = F.when(t == ",", gaps[0]).when(t == ":", gaps[1]).when(t.startswith('"' + MARK), F.substring(t, F.lit(3), F.length(t) - 3)).when(t.startswith('"'), string(t))
        for word, other in words.items():
            out = out.when(t == word, other)
        return out.when(t == "-0", "0").when(t.rlike(REAL), F.concat(F.lit('"' + MARK), real, F.lit('"')) if marked else real).otherwise(t)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), token), "")


def _quoted(t: Column) -> Column:
    """The token of a JSON string as Python's ``repr`` spells the string; double quotes only where it holds single ones."""

    def body(s: Column) -> Column:
        single, double = s.contains("'"), s.contains('"')
        json = json_string(s)
        # Escapes as in JSON, but for quotes and for control characters without a letter of their own.
        parts = F.regexp_extract_all(F.substring(json, F.lit(2), F.length(json) - 2), F.lit(r"\\u[0-9a-f]{4}|\\.|[^\\]+"), F.lit(0))
        other = lambda p: F.when(p == r"\"", '"').when(p == r"\b", r"\x08").when(p == r"\f", r"\x0c").when(p.startswith(r"\u"), F.concat(F.lit(r"\x"), F.substring(p, 5, 2))).otherwise(F.replace(p, F.lit("\x7f"), F.lit(r"\x7f")))
        told = F.array_join(F.transform(parts, other), "")
        return F.when(single & ~double, F.concat(F.lit('"'), told, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(told, F.lit("'"), F.lit(r"\'")), F.lit("'")))

    return let(F.try_variant_get(F.try_parse_json(t), "$", "string"), body)


def as_json(x: Column, sort_keys: bool = False) -> Column:
    """A value as ``json.dumps`` spells it, with keys in their order or sorted; characters beyond ASCII stay."""
    gaps, plain = (", ", ": "), {}
    text = x["text"]
    if sort_keys:
        sorted_ = F.to_json(F.try_parse_json(_spelled(text, (",", ":"), plain, lambda t: t, marked=True)))
        text = F.when(text.contains("{"), sorted_).otherwise(text)
    # Readers escape characters beyond the 16-bit range, which Python does not.
    nested = _spelled(text, gaps, plain, lambda t: F.when(t.contains("\\u"), json_string(F.try_variant_get(F.try_parse_json(t), "$", "string"))).otherwise(t))
    return F.when(x["kind"] == "VOID", "null").when(x["kind"] == "STRING", json_string(x["text"])).otherwise(nested)


def as_text(x: Column) -> Column:
    """A value as Python's ``str`` spells it: strings as they are, None, True and False, lists by their items' ``repr``."""
    words = {"null": "None", "true": "True", "false": "False"}
    return F.when(x["kind"] == "VOID", "None").when(x["kind"] == "STRING", x["text"]).otherwise(_spelled(x["text"], (", ", ": "), words, _quoted))
