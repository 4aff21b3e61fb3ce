"""Reading and writing: round trips, damaged lines, manifests, streams."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import logs, observations, sinks
from tidemark.streaming import events as stream


def line(seq, process="p1", kind="request_arrival"):
    return json.dumps({
        "schema_version": "telemetry.v1", "event_type": kind, "ts_wall_ns": 1_700_000_000_000_000_000 + seq, "ts_mono_ns": seq, "process_start_wall_ns": 1, "process_start_mono_ns": 1, "host_id": "h", "component": "proxy", "process_id": 7,
        "process_instance_id": process, "event_seq": seq, "experiment_id": None, "run_id": "r", "config_id": None, "trace_id": "t", "attempt_id": 0, "request_id": "q", "external_request_id": None, "payload": {"n": 9007199254740993},
    })


@pytest.fixture
def run(tmp_path):
    folder = tmp_path / "raw" / "proxy"
    folder.mkdir(parents=True)
    (folder / "p1.00000.jsonl").write_text("\n".join([line(1), line(2), "{bad json}", line(0), line(5)]) + "\n")
    (folder / "p1.summary.json").write_text(json.dumps({"process_instance_id": "p1", "events_enqueued": 5, "events_written": 4}, indent=1))
    return str(tmp_path / "raw")


def test_read_events(spark, run):
    found = logs.read_events(spark, run)
    assert sorted((r.event_seq or -1, r.damage or "") for r in found.collect()) == [(-1, "not_json"), (-1, "sequence_not_positive"), (1, ""), (2, ""), (5, "")]
    good = found.where("damage is null")
    assert good.select(F.get_json_object("payload", "$.n").cast("long")).first()[0] == 9007199254740993
    assert logs.read_summaries(spark, run).first().events_enqueued == 5


def test_stream_counts_and_gaps(spark, run, tmp_path):
    gaps = []
    q = stream.each_batch(stream.sequence_gaps(stream.read(spark, run + "/proxy/*.jsonl")), lambda df, _: gaps.extend(df.collect()), str(tmp_path / "c1"))
    q.awaitTermination(120)
    assert [(r.expected, r.found) for r in gaps] == [(3, 5)]
    out = []
    q = stream.each_batch(stream.window_counts(stream.read(spark, run + "/proxy/*.jsonl"), "5 seconds", "1 second"), lambda df, _: out.extend(df.collect()), str(tmp_path / "c2"), "update")
    q.awaitTermination(120)
    assert [r.n for r in out] == [3]


def test_tables_manifest_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("r", "c", str(i), "d") for i in range(12)], "run_id string, code string, key string, detail string")
    path = str(tmp_path / "t")
    sinks.write_table(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_table(df, path)
    assert sinks.read_table(spark, path, "run_id string, code string").count() == 12
    assert sinks.read_table(spark, str(tmp_path / "none"), "a int").columns == ["a"]
    value = sinks.report({"n": 1}, df)
    assert not value["valid"] and value["violations"][0]["count"] == 12 and len(value["violations"][0]["examples"]) == 10
    assert sinks.sealed(spark, path, str(tmp_path / "m"), df.where("false")) and not sinks.sealed(spark, path, str(tmp_path / "m2"), df)
    (tmp_path / "t" / "new.bin").write_bytes(b"x")
    assert [r.problem for r in sinks.manifest_mismatches(sinks.manifest(spark, path), spark.read.parquet(str(tmp_path / "m"))).collect()] == ["new"]


def test_text_sources(spark):
    text = spark.createDataFrame([('m{a="1"} 2.5',), ("m 1e1",), ("# TYPE m counter",), ("broken",)], "value string")
    assert sorted(r.number for r in logs.prometheus(text).collect()) == [2.5, 10.0]
    lines = spark.createDataFrame([('{"timestamp": "2024-01-01T00:00:01Z", "engine": "e", "metrics": {"a": 1}}',), ("x",)], "value string")
    assert sorted(r.error or "" for r in observations.observations(lines).collect()) == ["", "not_json"]
    config = spark.createDataFrame([(1, "model: 'm1'"), (2, "model: m2"), (3, "other = 3")], "n int, value string")
    assert sorted(map(tuple, observations.config_values(config, ["model", "other"]).collect())) == [("model", "m1"), ("other", "3")]


@pytest.mark.parametrize("most", [64, 1000, 1 << 27])
def test_lines_have_their_numbers_however_files_are_split(spark, tmp_path, most):
    texts = {"a.jsonl": ["x" * (i % 37) for i in range(500)], "b.jsonl": [""], "c.jsonl": ["y", "", "", "z"], "sub/a.jsonl": ["é" * 50] * 20}
    for name, lines in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    try:
        found = [(r.source_file.split(tmp_path.name + "/")[1], r.line, r.value) for r in logs.numbered(spark, str(tmp_path), "*.jsonl").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(found) == sorted((name, i + 1, x) for name, lines in texts.items() for i, x in enumerate(lines))
