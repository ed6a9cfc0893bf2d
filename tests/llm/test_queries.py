import hashlib
import os
import re
import zlib

import duckdb
import pytest

from tests.oracle import DATA, assert_same
from verdict.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_media_query(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows = registry.QUERIES["op6_media"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        raw, n = raw + bytes(-len(raw) % 64 if raw else 64), len(raw)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (n, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))


def test_html_query(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall())
    import html

    for r in registry.QUERIES["op9_html"](spark, DATA).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.sub(r"</?(?:p|h1)>|<br>", "\0", re.sub("</?b>", "", article)).split("\0")
        assert r.text == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name,label", [("op1_toxicity", "toxic"), ("op3_quality", "quality")])
def test_classifier_queries(spark, name, label):
    rows = {r.doc_id: r for r in registry.QUERIES[name](spark, DATA).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{DATA}/labels.parquet'").fetchall())
    held = [rows[k].predicted == v for k, v in truth.items() if rows[k].held_out]
    assert sum(held) / len(held) > 0.8
