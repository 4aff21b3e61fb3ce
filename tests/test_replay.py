"""One run from JSON lines to sealed windows, and what keeps a run from being sealed."""

import json
import os
import random

import pytest

from tidemark.operators import events as rules
from tidemark.operators import replay
from tidemark.sources import logs, sinks
from tidemark.streaming import events as stream
from tidemark.streaming.events import finished_traces, read, to_table

KV = {"tp_rank": 0, "tp_size": 1, "actual_bytes": 64}
PROBE = {"computed_tokens_before": 0, "scheduled_tokens": 7, "computed_tokens_after": 7, "handoff_token_count": 0}


def members(n):
    return lambda i: {"iteration_id": i, "members": [{"request_id": f"q{i}", "scheduled_tokens": n}]}


def iteration(n):
    return lambda i: {"iteration_id": i, "scheduled_tokens_total": n, "scheduled_request_count": 1}


STEPS = [
    ("proxy", "request_arrival", 0, {"input_tokens": 7}), ("proxy", "admission_decision", 1, {"accepted": True}), ("proxy", "prefill_http_submit", 5, {}), ("prefill", "engine_request_added", 8, {"prompt_tokens": 7}),
    ("prefill", "scheduler_membership", 13, members(7)), ("prefill", "scheduler_iteration", 13, iteration(7)), ("prefill", "prefill_accounting_probe", 14, PROBE), ("prefill", "engine_request_terminal", 18, {}),
    ("proxy", "prefill_http_complete", 19, {}), ("proxy", "p_to_d_route", 20, {"selected_decoder": "x:13701"}), ("proxy", "decode_http_submit", 21, {}), ("decode-0", "kv_transfer_enqueued", 24, KV), ("decode-0", "kv_transfer_started", 26, KV),
    ("decode-0", "kv_transfer_completed", 30, KV), ("decode-0", "engine_request_added", 33, {}), ("decode-0", "scheduler_membership", 34, members(1)), ("decode-0", "scheduler_iteration", 34, iteration(1)),
    ("proxy", "decode_first_byte", 35, {}), ("proxy", "request_complete", 47, {}),
]


def write(folder, skip=(), extra=(), other=None):
    lines: dict[str, list[str]] = {}
    for i, start in enumerate((1000, 1013, 1100)):
        for component, kind, at, payload in STEPS:
            if (i, kind) in skip:
                continue
            payload = (other or {}).get((i, component, kind), payload)
            payload = payload(i) if callable(payload) else payload
            seq = len(lines.setdefault(component, [])) + 1
            ts = start + at
            lines[component].append(json.dumps({
                "schema_version": "telemetry.v1", "event_type": kind, "ts_wall_ns": ts, "ts_mono_ns": ts, "process_start_wall_ns": 0, "process_start_mono_ns": 0, "host_id": "h", "component": component, "process_id": 1, "process_instance_id": component,
                "event_seq": seq, "experiment_id": "e", "run_id": "r", "config_id": "c", "trace_id": f"t{i}", "attempt_id": 0, "request_id": f"q{i}", "external_request_id": None, "payload": payload,
            }))
    for component, found in lines.items():
        (folder / component).mkdir(parents=True)
        (folder / component / "a.00000.jsonl").write_text("\n".join([*found, *(extra if component == "proxy" else ())]) + "\n")
        (folder / component / "a.summary.json").write_text(json.dumps({"process_instance_id": component, "events_enqueued": len(found), "events_written": len(found), "events_dropped": 0}))


def test_from_lines_to_sealed_windows(spark, tmp_path):
    write(tmp_path / "raw")
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    contract = spark.createDataFrame([("r", 1000, 1000 + 15_000_000, 1)], "run_id string, start_ns long, end_ns long, period_ms int")
    ok, report = replay.sealed(spark, raw, out, 10, contract, "telemetry.v1")
    assert ok and report["valid"] and report["metrics"] == {"windows": 15, "events": 3 * len(STEPS)}
    rows = {r.window_id: r for r in spark.read.parquet(str(tmp_path / "out/windows")).collect()}
    assert [rows[k].active for k in (100, 102, 104, 105, 107, 110, 114)] == [1, 2, 2, 1, 0, 1, 1]
    # at 1010 request 0 is added but not scheduled before 1013
    assert rows[101].PREFILL_WAITING == 1 and rows[103].KV_READY == 1 and rows[102].HANDOFF_WAITING == 1 and rows[104].DECODE_RUNNING == 1 and rows[103].PREFILL_RUNNING == 1
    life = {r.request_id: r for r in replay.lifecycles(logs.read_events(spark, raw)).collect()}
    assert (life["q1"].prefill_scheduled_ns, life["q1"].decode_scheduled_ns) == (1026, 1047)
    assert {r.source_component for r in logs.read_events(spark, raw).collect()} == {"proxy", "prefill", "decode-0"}
    assert [r.event_seq for r in logs.ordered(logs.read_events(spark, raw)).collect()][:9] == list(range(1, 10))
    verified = lambda: sorted(map(tuple, sinks.verified(spark, replay.files(raw, out), f"{out}/manifest").collect()))
    assert verified() == []
    with (tmp_path / "raw/prefill/a.00000.jsonl").open("a") as f:
        f.write("\n")
    (tmp_path / "out/report/more").write_text("x")
    assert verified() == [("raw/prefill/a.00000.jsonl", "changed"), ("report/more", "new")]


def test_internal_violations_keep_a_run_open(spark, tmp_path):
    write(tmp_path / "raw", skip={(2, "kv_transfer_started")}, other={(0, "prefill", "scheduler_iteration"): iteration(8), (1, "proxy", "p_to_d_route"): {"selected_decoder": "x:13702"}, (1, "prefill", "prefill_accounting_probe"): PROBE | {"computed_tokens_after": 6}})
    contract = spark.createDataFrame([("r", 1000, 1000 + 14_000_000, 1)], "run_id string, start_ns long, end_ns long, period_ms int")
    ok, report = replay.sealed(spark, str(tmp_path / "raw"), str(tmp_path / "out"), 10, contract)
    codes = {v["code"] for v in report["violations"]}
    assert not ok and not (tmp_path / "out/manifest").exists()
    assert codes == {
        "membership_token_sum_mismatch", "kv_complete_without_start", "kv_transfer_missing_terminal", "pd_attempt_kv_transfer_failed", "pd_attempt_kv_ready_missing", "pd_attempt_kv_rank_missing", "kv_lifecycle_violation",
        "proxy_route_worker_mismatch", "proxy_route_kv_worker_mismatch", "prefill_accounting_unproven", "measurement_window_count_mismatch",
    }


def test_sealed_runs_merge_in_one_scan(spark, tmp_path):
    broken = spark.createDataFrame([], "run_id string, code string, key string, detail string")
    for run in ("r1", "r2", "r3", "r4"):
        df = spark.range(3).selectExpr("id window_id", "id * 2 v") if run != "r4" else spark.range(3).selectExpr("id window_id", "cast(id as int) v")
        sinks.write_table(df, str(tmp_path / run / "windows"))
        if run != "r3":
            assert sinks.sealed(spark, {"windows": str(tmp_path / run / "windows")}, str(tmp_path / run / "manifest"), broken, {"windows": df})
    splits = lambda *rows: spark.createDataFrame(rows, "run_id string, split string")
    found = sinks.merged(spark, str(tmp_path), splits(("r1", "train"), ("r2", "test")))
    assert sorted((r.run_id, r.split, r.window_id, r.v) for r in found.collect()) == [(r, s, i, 2 * i) for r, s in (("r1", "train"), ("r2", "test")) for i in range(3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    for rows, why in (((("r1", "a"), ("r3", "a")), "sealed"), ((("r1", "a"), ("r1", "b")), "several"), ((("r1", "a"), ("r4", "a")), "schemas")):
        with pytest.raises(ValueError, match=why):
            sinks.merged(spark, str(tmp_path), splits(*rows))


def test_a_damaged_run_is_not_sealed(spark, tmp_path):
    write(tmp_path / "raw", skip={(1, "request_complete"), (2, "prefill_http_submit")}, extra=["{bad"])
    ok, report = replay.sealed(spark, str(tmp_path / "raw"), str(tmp_path / "out"), 10)
    codes = {v["code"] for v in report["violations"]}
    assert not ok and not (tmp_path / "out/manifest").exists()
    assert {"jsonl_damaged_line", "terminal_event_missing", "accepted_request_without_terminal_state", "prefill_complete_without_submit"} <= codes


def test_rotated_lines_keep_order_and_size(spark, tmp_path):
    rows = [("r", p, i, "x" * (i % 50)) for p in ("a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "run_id string, process_instance_id string, event_seq int, body string")
    sinks.write_rotated(df, str(tmp_path / "log"), ["event_seq"], most_bytes=2000)
    for p in ("a", "b"):
        parts = sorted((tmp_path / "log/run_id=r" / f"process_instance_id={p}").glob("part=*/*.txt"), key=lambda f: int(f.parent.name[5:]))
        assert len(parts) > 5 and all(f.stat().st_size <= 2000 for f in parts)
        assert [json.loads(x)["event_seq"] for f in parts for x in f.read_text().splitlines()] == list(range(200))
    long = spark.createDataFrame([("r", 1, "a", 2), ("r", 1, "b", 3), ("r", 2, "a", 1)], "run_id string, window_id int, name string, v int")
    sinks.write_sidecar(long, str(tmp_path / "wide"), ["run_id", "window_id"], "name", "v", ["a", "b", "c"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "wide")).select("window_id", "a", "b", "c").collect())) == [(1, 2, 3, 0), (2, 1, 0, 0)]


def test_traces_finish_once_in_a_stream(spark, tmp_path):
    write(tmp_path / "raw", skip={(2, "request_complete")})
    stream = finished_traces(read(spark, str(tmp_path / "raw/proxy"), files_at_once=1))
    to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    rows = {r.trace_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sorted(rows) == ["t0", "t1"] and (rows["t0"].request_arrival, rows["t0"].decode_first_byte, rows["t0"].terminal_event, rows["t0"].terminal_mono_ns) == (1000, 1035, "request_complete", 1047)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_lifecycles_are_those_of_the_batch(spark, tmp_path, seed):
    """Lines in any order, cut to any files; traces that end, that don't, that end twice or break rules."""
    write(tmp_path / "raw", skip={(1, "request_complete"), (2, "prefill_http_submit")}, extra=["{bad"])
    rng = random.Random(seed)
    lines = [json.loads(x) for f in (tmp_path / "raw").rglob("*.jsonl") for x in f.read_text().splitlines() if x.startswith("{\"")]
    more = []
    for k in range(3, 40):
        for x in lines:
            if x["trace_id"] == f"t{k % 3}" and rng.random() < 0.95:
                more.append(x | {"trace_id": f"t{k}", "request_id": f"q{k}", "ts_wall_ns": x["ts_wall_ns"] + k, "ts_mono_ns": x["ts_mono_ns"] + k, "event_seq": x["event_seq"] + 1000 * k})
    every = [x | {"ts_wall_ns": 1_700_000_000_000_000_000 + 1_000_000 * x["ts_wall_ns"]} for x in lines + more]
    rng.shuffle(every)
    files = tmp_path / "stream"
    files.mkdir()
    cuts = [0, *sorted(rng.sample(range(1, len(every)), 5)), len(every)]
    beat = every[0] | {"event_type": "heartbeat", "trace_id": None, "ts_wall_ns": every[0]["ts_wall_ns"] + 10**14, "event_seq": 10**6}
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        (files / f"{i}.jsonl").write_text("".join(json.dumps(x) + "\n" for x in every[a:b]))
        os.utime(files / f"{i}.jsonl", (1000 + i, 1000 + i))
    (files / "9.jsonl").write_text(json.dumps(beat) + "\n")
    done = stream.lifecycles(stream.completed(stream.read(spark, str(files), 1), "100 seconds"), str(tmp_path / "out"), str(tmp_path / "check"))
    done.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress][-1] == 0
    events = logs.event_rows(spark.read.text(str(files))).where("damage is null")
    plain = lambda df: sorted(str([(c, sorted(v, key=str) if isinstance(v, list) else v) for c, v in sorted(r.asDict().items()) if c not in ("batch", "process_instance_id")]) for r in df.collect())
    for name, make in (("attempts", rules.attempts), ("traces", rules.traces), ("violations", rules.lifecycle_violations)):
        assert plain(spark.read.parquet(str(tmp_path / "out" / name)).drop("batch")) == plain(make(events)), name
