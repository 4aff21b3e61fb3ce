"""Queries against their SQL where rows agree in all that their order goes by."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import time, vectors
from tidemark.plans import all_oracles, all_queries
from tidemark.plans.registry import Tables

DAY = datetime.timedelta(days=1)


def against_sql(spark, folder, name, tables):
    """The rows of a query over tables (name -> (schema, rows)) and those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for table, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    df, wanted = all_queries()[name](spark, str(folder)), con.sql(all_oracles()[name])
    rows = lambda columns, found: sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found), key=repr)
    return rows(df.columns, df.collect()), rows(wanted.columns, wanted.fetchall())


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
LINES = "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.mark.parametrize("first, second", [(1.0, 40.0), (40.0, 1.0)])
def test_memberships_at_one_time_do_not_come_before_each_other(spark, tmp_path, first, second):
    start = datetime.datetime(1996, 1, 1)
    orders = [(i, i, "O", 30_000.0 + 1_000 * i, start + (i % 7) * DAY, "5-LOW") for i in range(60)]
    lines = [(i, s, n, q, at + d * DAY) for i, _, _, _, at, _ in orders for s in (0, i % 3 + 1) for n, d, q in ((1, 2, 3.0), (2, 5, first), (2, 5, second), (3, 23, first), (3, 23, second))]
    tables = {"orders": (ORDERS, orders), "lineitem": (LINES, lines), "events": (EVENTS, [])}
    found, wanted = against_sql(spark, tmp_path, "state_blocks", tables)
    assert found == wanted
    assert {r[0] for r in found} > {"prefill_running", "decode_wait", "decode_context"}
    assert Tables(spark, str(tmp_path)).em.groupBy("request_id", "component", "ts_ns", "seq").count().where("count > 1").count() > 0


def test_nearest_sample_asks_only_stretches_between_centres(spark, tmp_path):
    """Samples on centres and on hours, hours without any, an event without a time; no frame of a window shrinks row by row."""
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    kinds = [("click", 5), ("error", 30), ("view", 65), ("click", 200), ("error", 269), ("error", 271), ("click", 330), ("view", 725), ("error", 840), ("click", 2000)]
    events = [(i, at(m), i % 3, kind, 1.0, '{"k": 1}') for i, (kind, m) in enumerate(kinds)] + [(90, None, 1, "error", 1.0, '{"k": 1}')]
    tables = {"orders": (ORDERS, []), "lineitem": (LINES, []), "events": (EVENTS, events)}
    found, wanted = against_sql(spark, tmp_path, "nearest_sample", tables)
    assert found == wanted and len(found) == 9
    plan = all_queries()["nearest_sample"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and plan.count("relation [") + plan.count("relation parquet") <= 1


def test_nearest_frames_only_grow(spark):
    left, right = spark.createDataFrame([("a", 5), ("a", 11), ("b", 1)], "k string, t long"), spark.createDataFrame([("a", 5), ("a", 9), ("a", 14)], "k string, u long")
    found = time.nearest(left, right, ["k"], "t", "u")
    assert sorted(map(tuple, found.collect())) == [("a", 5, 0), ("a", 11, 2), ("b", 1, None)]
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_intervals_are_cut_in_one_pass_and_only_where_they_count(spark, tmp_path):
    """The scan of requests isn't repeated for those that enter and those that leave, and marks take one window."""
    for table, (schema, values) in {"orders": (ORDERS, []), "lineitem": (LINES, [])}.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    plan = all_queries()["state_blocks"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().lower()
    steps = [line.strip(" +-:") for line in plan.splitlines()]
    assert (sum(s.startswith("relation") for s in steps), sum(s.startswith("window") for s in steps)) == (3, 2)


def test_cells_are_the_bins_that_a_span_passes(spark):
    spans = [(i, s, e, a) for i, (s, e, a) in enumerate([(0, 5, 0), (3, 30, 1), (3, None, 1), (12, 13, 0), (7, 40, None), (0, 100, 50), (10, 11, 0), (9, 10, 0), (20, 21, 40)])]
    df = spark.createDataFrame(spans, "id long, start_ns long, end_ns long, at long")
    none, one = F.lit(""), F.lit(1)
    of = [(F.col("id") >= 0, vectors.aged("aged", "at", [0, 10, 20], none, one, one)), (F.col("id") >= 0, vectors.slack("slack", "at", 15, [0, 10, 20], none, one, one)), (F.col("id") == 3, vectors.whole("whole", none, one, F.lit(7), one))]
    found = {(r.id, r.block, t): r.y for r in vectors.cells(df, of, ["id"]).collect() for t in range(r.start_ns, r.end_ns or 60)}
    wanted = {(3, "whole", 12): 7}
    for i, s, e, a in spans:
        for t in range(s, e or 60):
            wanted[i, "aged", t] = 0 if a is None else sum(t - a >= x for x in (10, 20))
            wanted[i, "slack", t] = 3 if a is None else sum(15 - (t - a) >= x for x in (0, 10, 20))
    assert found == wanted


def test_snapshots_replay_a_log_that_is_written_once(spark, tmp_path):
    """What the branches of the replay read is the log, not the tables that it is made of."""
    start = datetime.datetime(1996, 1, 1)
    tables = {"orders": (ORDERS, [(i, i, "O", 30_000.0, start, "5-LOW") for i in range(3)]), "lineitem": (LINES, [(i, 1, 1, 2.0, start + DAY) for i in range(3)])}
    for table, (schema, values) in tables.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    read = all_queries()["snapshot_vectors"](spark, str(tmp_path)).inputFiles()
    assert read and not any(str(tmp_path) in file for file in read)
