"""Text functions as pure column expressions."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, for Java's regular expressions.
BLANK = r"(?U)[\s\x1c-\x1f]"
FENCE = "```"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def py_strip(text: Column) -> Column:
    """Removes white space of all kinds at both ends."""
    return F.regexp_replace(text, rf"\A{BLANK}+|{BLANK}+\z", "")


def normalize_output(text: Column) -> Column:
    """One kind of line end, no white space around lines, no blank lines at the ends; null becomes empty."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n"), "\n", -1)
    return F.btrim(F.array_join(F.transform(lines, py_strip), "\n"), F.lit("\n"))


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(py_strip(text), rf"{BLANK}+", " ")


@cache
def folds() -> tuple[str, str, dict[str, str]]:
    """What Unicode's full case folding changes: characters and what single ones become, and those that become several."""
    changed = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.casefold() != c}
    single = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in changed.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full Unicode case folding, as Python's ``casefold``: a character at a time, whatever stands around it."""
    single, folded, several = folds()
    every = "[" + "".join(several) + "]"
    one = F.translate(text, single, folded)
    # Texts of such characters alone are taken apart; they are told from the longer bytes of what lies beyond ASCII.
    parts = F.regexp_extract_all(text, F.lit(f"{every}|[^{every[1:]}+"), F.lit(0))
    known = F.map_from_arrays(F.array(*map(F.lit, several)), F.array(*map(F.lit, several.values())))
    many = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), F.translate(p, single, folded))), "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(text.rlike(every), many).otherwise(one)


def canonical_key(statement: Column, io_mode: Column, entry_point: Column, ident: Column, fold: Callable[[Column], Column] = casefold) -> Column:
    """The key under which problems are equivalent: mode, signature and folded statement; blank statements stand alone."""
    body = fold(collapse_blanks(F.coalesce(statement, F.lit(""))))
    signature = F.when(io_mode == "callable", fold(py_strip(F.coalesce(entry_point, F.lit(""))))).otherwise("")
    return F.when(body == "", F.concat(F.lit("id:"), ident)).otherwise(F.concat_ws("|", io_mode, signature, body))


def extract_python_code(text: Column) -> Column:
    """The first fenced block marked python or py, in any case; empty without one."""
    return py_strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?isU){FENCE}(?:python|py)[\s\x1c-\x1f]*(.*?){FENCE}", 1))


STRICT_FENCE = rf"(?sU)\A{FENCE}python[\s\x1c-\x1f]*\n(.*)\n{FENCE}[\s\x1c-\x1f]*\z"


def is_fenced(text: Column) -> Column:
    """True if the whole text is exactly one code block."""
    return py_strip(text).rlike(STRICT_FENCE)


def fenced_code(text: Column) -> Column:
    return F.when(is_fenced(text), F.regexp_extract(py_strip(text), STRICT_FENCE, 1))


def safe_slug(name: Column, index: Column, prefix: str = "problem") -> Column:
    slug = F.substring(F.lower(F.btrim(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), F.lit("_"))), 1, 80)
    return F.concat(F.lit(f"{prefix}_"), index.cast("string"), F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("problem")))


def parse_number(text: Column, default: float) -> Column:
    """The first number in a text, else ``default``."""
    found = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+(?:\.\d+)?", 0), F.lit(""))
    return F.coalesce(found.try_cast("double"), F.lit(float(default)))


def problem_seed(base: int | Column, ident: Column) -> Column:
    """A seed per problem from the first four bytes of the id's sha256."""
    base = F.lit(base) if isinstance(base, int) else base
    return F.pmod(base + F.conv(F.substring(F.sha2(ident, 256), 1, 8), 16, 10).cast("long"), F.lit(2_147_483_648))


def code_hash(code: Column) -> Column:
    return F.when(F.coalesce(code, F.lit("")) != "", F.sha2(code, 256)).otherwise("")


#: Fixed value: what counts as reading standard input.
READS_STDIN = r"\binput\s*\(|sys\.stdin|open\s*\(\s*0\b|fileinput\.|os\.read\s*\(\s*0\b"


def looks_hardcoded(code: Column, io_mode: Column, inputs: Column) -> Column:
    """A program that never reads its input although some case of ``inputs`` has any."""
    given = F.exists(inputs, lambda x: py_strip(F.coalesce(x, F.lit(""))) != "")
    return (io_mode == "stdin") & given & ~F.coalesce(code, F.lit("")).rlike(READS_STDIN)


def message_text(messages: Column) -> Column:
    """The contents of a chat, one below the other; null contents are empty."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


def case_quotas(n: Column, visible: int, reward: int, evaluation: int) -> Column:
    """How many of ``n`` cases go to each suite, as a struct; what exceeds the maxima is left out."""
    first = F.when((n >= 3) & F.lit(reward > 0 and evaluation > 0), F.least(F.lit(visible), n - 2)).when((n == 2) & F.lit(reward > 0), F.lit(1)).otherwise(F.least(F.lit(visible), n))
    rest = n - first
    shared = (rest >= 2) & F.lit(reward > 0 and evaluation > 0)
    held = F.least(F.lit(evaluation), F.greatest(F.lit(1), F.floor(rest / 3).cast("int")))
    second = F.when(shared, F.least(F.lit(reward), rest - held)).otherwise(F.least(F.lit(reward), rest))
    third = F.least(F.lit(evaluation), rest - second)
    return F.struct(first.cast("int").alias("visible"), second.cast("int").alias("reward"), third.cast("int").alias("eval"))
