"""Resuming stages and the guards around them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from verdict.sources import io


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet. Spark broadcasts the done ids if they are few."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def require_none(rows: DataFrame, message: str) -> None:
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {', '.join(str(tuple(r)) for r in found)}")


def consistent_pair(spark: SparkSession, data: str, sidecar: str) -> bool:
    """True if both exist, False if neither; one without the other is an error."""
    found = io.exists(spark, data), io.exists(spark, sidecar)
    if found[0] != found[1]:
        raise ValueError(f"{data} and {sidecar} belong together, and one is missing")
    return found[0]


def same_run(before: dict, now: dict, keys: Iterable[str] | None = None) -> None:
    """Refuses to resume under another configuration, and names what differs."""
    names = sorted(set(before) | set(now)) if keys is None else list(keys)
    different = [k for k in names if before.get(k) != now.get(k)]
    if different:
        raise ValueError("the run to resume differs in: " + ", ".join(different))


def require_role(metadata: dict, role: str) -> None:
    if metadata.get("role") not in (None, role):
        raise ValueError(f"the data are of split {metadata['role']!r}, not {role!r}")


def require_at_least(**bounds: tuple[int, int]) -> None:
    """``name=(value, least)``."""
    for name, (value, least) in bounds.items():
        if value < least:
            raise ValueError(f"{name} must be at least {least}")


def accepted_arguments(function, given: dict) -> dict:
    """Those of ``given`` that ``function`` takes."""
    import inspect

    return {k: v for k, v in given.items() if k in inspect.signature(function).parameters}
