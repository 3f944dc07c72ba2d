"""Line dedup: against SQL, both ways of removal, exact counts near the threshold, odd rows."""

import pytest

from sparkloom.llm import line_dedup
from sparkloom.llm.line_dedup import Spread, remove_boilerplate


def test_query_matches_duckdb(spark, small, duck, same):
    same(line_dedup.op8_line_dedup(spark, small).toPandas(), duck.execute(line_dedup.SQL).df())


@pytest.mark.parametrize("listed", [50_000, 0])
def test_spread_decides(spark, listed):
    rows = [(i, f"own {i}\n common \nrare\n\n  ", f"s{i % 6}") for i in range(12)] + [(i, "common\nfew\nown", f"s{i % 4}") for i in range(12, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in remove_boilerplate(docs, Spread(max_listed=listed)).collect()}
    assert got[3] == ("own 3\n\n  ", 5, 2)
    assert got[12] == ("few\nown", 3, 1)


@pytest.mark.parametrize("listed", [50_000, 0])
def test_many_sites(spark, listed):
    """Beyond what a sketch counts exactly: lines on each side of a threshold of 300 sites."""
    rows = [(i, f"a\n{'b' if i < 300 else 'c'}\n{'d' if i < 299 else 'e'}", f"site{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in remove_boilerplate(docs, Spread(min_sites=300, max_listed=listed)).collect()}
    assert got[0] == "d" and got[299] == "" and got[599] == ""


@pytest.mark.parametrize("listed", [50_000, 0])
def test_odd_rows(odd, clashing, nothing, listed):
    got = remove_boilerplate(odd, Spread(min_sites=2, max_listed=listed)).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] == "" and by[8][0]["text"] == "" and len(by[8]) == 2
    assert by[3][0]["text"] is None and by[3][0]["n_lines"] == 0 and by[4][0]["n_lines"] == 1
    assert remove_boilerplate(clashing).columns[: len(clashing.columns)] == clashing.columns
    assert remove_boilerplate(nothing).count() == 0
