"""Gates on responses and the state of control runs, by hand."""

import pytest

from tidemark.operators import control, gates

KEYS = "point string, run int, signal string, low double, high double, effect double"


def test_authority_counts_runs_that_answer(spark):
    found = spark.createDataFrame(
        [("a", 1, "x", 1.0, 2.0, 0.3), ("a", 1, "y", 2.0, 1.0, 0.9), ("a", 2, "x", 1.0, 2.0, 0.25), ("a", 3, "x", 1.0, 2.0, 0.24), ("b", 1, "x", None, 2.0, 0.5), ("b", 2, "x", 1.0, 2.0, None), ("b", 3, "x", 1.0, 2.0, 0.4)], KEYS
    )
    assert sorted(tuple(r) for r in gates.authority(found, ["point"], "run").collect()) == [("a", 3, 2, True), ("b", 3, 1, False)]


def test_held_out_responses_lie_between_known_ones(spark):
    known = spark.createDataFrame([("a", "x", 0.0, 10.0)], "point string, signal string, low double, high double")
    cases = {1: (-2.0, 12.0, 0.3), 2: (-2.1, 12.0, 0.3), 3: (3.0, 12.1, 0.3), 4: (5.0, 4.0, 0.3), 5: (3.0, 4.0, 0.2)}
    rows = [("a", k, "x", *v) for k, v in cases.items()] + [("a", k, "route", 0.4, 0.6 if k != 2 else 0.4, None) for k in cases] + [("z", 6, "x", 3.0, 4.0, 0.5)]
    found = {r.run: (r.route_ok, r.state_ok) for r in gates.interpolated(spark.createDataFrame(rows, KEYS), known, ["point"], "run", "signal", "route").collect()}
    assert found == {1: (True, True), 2: (False, False), 3: (True, False), 4: (True, False), 5: (True, False), 6: (False, False)}


def test_robust_runs_follow_the_level(spark):
    rows = [(1, 0.3, 0.31, 5.0, 1.0), (1, 0.5, 0.5, 4.0, 2.0), (1, 0.7, 0.71, 3.0, 3.0), (2, 0.3, 0.5, 1.0, 1.0), (2, 0.5, 0.5, 2.0, 2.0), (3, 0.3, 0.7, 1.0, 1.0), (3, 0.5, 0.5, 2.0, 2.0)]
    found = {r.run: r for r in gates.robust(spark.createDataFrame(rows, "run int, u double, r double, a double, b double"), ["run"], "u", "r", ["a", "b"]).collect()}
    assert found[1].ok and found[1].state == pytest.approx(1) and found[2].route is None and not found[2].ok and not found[3].ok


def test_responses_are_means_and_effects(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 4.0), ("a", 1, 6.0), ("b", 0, 1.0)], "k string, u int, v double")
    found = {r.k: r for r in gates.responses(rows, ["k"], "u", "v", 0, 1).collect()}
    assert (found["a"].low, found["a"].high, found["a"].effect) == (2.0, 5.0, pytest.approx(3 / 2**0.5)) and found["b"].effect is None


RUN = "run_id string, base_valid boolean, drained boolean, errors int, split string, topology string, pod_before string, pod_after string, restarts_before int, restarts_after int"


@pytest.fixture(scope="module")
def codes(spark):
    def of(run, events=(), slow=(True, True), writers=((5, 5, 0),), health=(200,)):
        df = lambda rows, schema: spark.createDataFrame([("r", *(x if isinstance(x, tuple) else (x,))) for x in rows], f"run_id string, {schema}")
        found = control.state_rules(spark.createDataFrame([run], RUN), df(events, "event_type string"), df(slow, "complete boolean"), df(writers, "enqueued int, written int, dropped int"), df(health, "status int"), 2, "held-out", "2-2-2")
        return {r.code for r in found.collect()}

    return of


GOOD = ("r", True, True, 0, "held-out", "2-2-2", "p", "p", 0, 0)


def test_state_of_a_good_run(codes):
    assert codes(GOOD, ["actuator_applied"]) == set()


def test_every_code_of_a_run_state(codes):
    assert codes(("r", False, False, 2, "train", "2-2-4", "p", "q", 0, 1), ["actuator_rejected", "actuator_safety_fallback"], (False,), ((5, 4, 1),), (503,)) == {
        "base_snapshot_invalid", "slow_window_count", "slow_control_fields_missing", "control_reject_present", "safety_fallback_present", "inventory_not_drained", "topology_drift", "writer_drop_nonzero",
        "writer_counter_mismatch", "workload_error_present", "health_sample_failure", "invalid_split", "pod_uid_changed", "pod_restart_detected",
    }


def test_unknown_state_is_broken(codes):
    assert codes(("r", *[None] * 9), [], (None, True), ((None, None, None),), (None,)) == {
        "base_snapshot_invalid", "slow_control_fields_missing", "inventory_not_drained", "topology_drift", "writer_drop_nonzero", "workload_error_present", "health_sample_failure", "invalid_split", "pod_uid_changed", "pod_restart_detected",
    }
    assert codes(GOOD, [], (), (), ()) == {"slow_window_count"}
