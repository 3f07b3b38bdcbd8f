"""Queries of the training-data operators that SQL can express, against DuckDB on the smaller data; cleaned texts by hand."""

import re

import duckdb
import pytest

pytest.importorskip("lakewright.llm")

from lakewright.llm import queries, quality_rules

TABLES = ("documents", "pages")


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name, folder):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = duck.sql(queries.oracle_sql()[name])
    frame = queries.queries()[name](spark, folder)
    got = sorted((tuple(r[c] for c in expected.columns) for r in frame.collect()), key=str)
    assert sorted(frame.columns) == sorted(expected.columns)
    assert got == sorted(expected.fetchall(), key=str)


def failed(line):
    """The rules of a line in plain Python."""
    w, low = re.findall(r"[^\x20\x09-\x0D]+", line), line.lower()
    any_ = "(?:" + "|".join(quality_rules.MENU) + ")"
    return bool(w) and (
        any(x in low for x in quality_rules.BOILERPLATE)
        or len(w) <= 12 and re.search(rf"^[\s|>»·-]*{any_}(?:[\s|>»·,-]+{any_})*[\s|>»·.-]*$", low) is not None
        or len(re.findall("[|»›·•]", line)) >= max(2, len(w) / 5)
        or len(w) >= 3 and 100 * len(re.findall(r"[#*$%&|<>]+|[!?]{2,}|[~^=_]{3,}", line)) >= quality_rules.MARKS_PER_100 * len(w)
        or len(w) >= 5 and line == line.upper() and line != low
        or len(w) >= 8 and 5 * len(set(w)) < len(w)
    )


def test_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in quality_rules.assess(docs).select("doc_id", "text", "quality.*").collect()}
    for r in got.values():
        lines = (r["text"] or "").split("\n")
        assert r["clean_text"] == "\n".join(x for x in lines if not failed(x)) and r["failed_lines"] == sum(map(failed, lines))
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines if failed(x))
        assert r["lost_words"] == lost and r["kept"] == (not r["base_failed"] and 100 * lost <= quality_rules.LOSS_PERCENT * r["n_words"])
    assert any(r["failed_lines"] for r in got.values()) and not all(r["kept"] for r in got.values())
