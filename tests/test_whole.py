"""Queries over whole inputs: what a bound or a filter on their rows would lose."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cuelake.plans import registry
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory, sf_dir):
    """Two documents of 30 lines, and the other tables of sf_dir."""
    at = tmp_path_factory.mktemp("long")
    for t in ("events", "conversations", "benchmark"):
        (at / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    texts = ["\n".join(f"line {k} of text {d} goes on for quite some time, and then" + (" it ends." if k % 2 else " so") for k in range(1, 31)) for d in (1, 2)]
    pq.write_table(pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": texts, "lang": ["en", "en"], "source": ["web", "web"]}), at / "documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def tables(long_dir, sf_dir):
    con = connect(sf_dir)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{long_dir}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", ["sink_srt", "sink_ass", "read_srt", "fold_merge", "sink_insert_srt", "sink_insert_ass", "segment_cues"])
def test_all_lines(name, spark, long_dir, tables):
    assert differences(registry.QUERIES[name](spark, long_dir), tables, registry.ORACLES[name]) == ""


def test_read_srt_rows(spark, long_dir):
    assert registry.QUERIES["read_srt"](spark, long_dir).count() == 60


@pytest.mark.parametrize("name", ["sink_insert_srt", "sink_insert_ass", "segment_cues", "fold_merge"])
def test_last_lines_are_there(name, spark, long_dir):
    got = " ".join("\n".join(r["text"] for r in registry.QUERIES[name](spark, long_dir).select("text").collect()).split())
    assert all(f"line {k} of" in got for k in range(1, 31))


@pytest.mark.parametrize("name", ["agg_median_level", "agg_speech_level"])
def test_all_intervals(name, spark, sf_dir):
    assert differences(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["ver_apply_units", "ver_rejections", "agg_refine_counters"])
def test_units_move_by_video_only(name, spark, sf_dir):
    """Lines, units and limits are dealt out by video once each, and nothing is written in between."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"(?<!Broadcast)Exchange ([^,]+)", plan)  # limits are broadcast while they are few
    assert {re.sub(r"#\d+L?", "", m) for m in moved} == {"hashpartitioning(video_id"} and len(moved) <= 3 and "ExistingRDD" not in plan
