"""Queries against their SQL on tables made for an edge; the other tables are the driver's."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.oracle import DATA, TABLES, assert_same
from verdict.plans.catalog import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


def with_table(folder, name, rows):
    for t in TABLES:
        if t != name:
            os.symlink(f"{DATA}/{t}.parquet", folder / f"{t}.parquet")
    schema = pq.read_schema(f"{DATA}/{name}.parquet")
    pq.write_table(pa.Table.from_pylist(rows, schema), folder / f"{name}.parquet")
    return str(folder)


def test_preflight_at_the_token_limit(spark, tmp_path):
    """Answers of a word less, as many and a word more than the SQL lets through; lines within them are no tokens."""
    answers = [" ".join(["w"] * n) for n in range(91, 98)] + ["a\nb " * 92 + "c", "a\nb " * 93 + "c", "", "x"]
    turns = [{"conv_id": k * 9 + 1, "turn": t, "role": ("user", "assistant")[t], "text": ("q", a)[t]} for k, a in enumerate(answers) for t in (0, 1)]
    assert_same(spark, QUERIES["q59_pack_preflight"], ORACLES["q59_pack_preflight"], with_table(tmp_path, "conversations", turns))
