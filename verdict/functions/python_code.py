"""What only Python can tell about Python code or text, as Arrow UDFs."""

from __future__ import annotations

import ast
import warnings

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


def compile_error(code: str | None) -> str | None:
    """None if the code compiles, else the message. Any failure to compile counts, so no task dies of its data."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            compile(code or "", "<candidate>", "exec")
    except (SyntaxError, ValueError, UnicodeError, RecursionError, MemoryError, OverflowError) as e:
        return str(e) or type(e).__name__
    return None


def parses(code: str | None) -> bool:
    """True if ``ast.parse`` takes the code; that is weaker than compiling it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            ast.parse(code or "")
    except (SyntaxError, ValueError, UnicodeError, RecursionError, MemoryError, OverflowError):
        return False
    return True


def warns(code: str | None) -> bool:
    """True if compiling the code raises a SyntaxWarning; invalid code does not warn."""
    try:
        with warnings.catch_warnings(record=True) as caught:
            warnings.simplefilter("always", SyntaxWarning)
            compile(code or "", "<candidate>", "exec")
    except (SyntaxError, ValueError, UnicodeError, RecursionError, MemoryError, OverflowError):
        return False
    return any(issubclass(w.category, SyntaxWarning) for w in caught)


@F.udf(StringType(), useArrow=True)
def syntax_error(code):
    return compile_error(code)


@F.udf(BooleanType(), useArrow=True)
def syntax_valid(code):
    return parses(code)


@F.udf(BooleanType(), useArrow=True)
def has_syntax_warning(code):
    return warns(code)


@F.udf(DoubleType(), useArrow=True)
def round6(value):
    """Rounds the binary value correctly to six digits, ties to even; the built-in rounds its decimal text half up."""
    return None if value is None else round(value, 6)
