"""The recurrent model's gradients and carried states; nearest neighbours against brute force; the pipeline."""

import os

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import ann, gru
from tidemark.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def test_gru_gradients():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.integers(1, 50, 128).astype(float), hidden=4).items()}
    p["W"], p["C"] = rng.standard_normal(p["W"].shape) * 0.3, rng.standard_normal(p["C"].shape) * 0.3
    texts = [rng.integers(0, 128, n) for n in (6, 3)]

    def loss(q):
        return -gru.log_likelihood(q, texts, 0).sum()

    class Seen(gru.Trainer):
        def _move(self, value, squares, g, at):
            name = next(k for k, v in self.p.items() if v is value)
            full = np.zeros_like(value)
            full[at] += g
            self.found[name] = full * self.seen

    t = Seen(p)
    t.found = {}
    t.train(texts, 0)
    for name, grad in t.found.items():
        at = np.unravel_index(np.argsort(-np.abs(grad), axis=None)[:3], grad.shape)
        for i in zip(*at, strict=True):
            q = {k: v.copy() for k, v in p.items()}
            q[name][i] += 1e-3
            up = loss(q)
            q[name][i] -= 2e-3
            assert (up - loss(q)) / 2e-3 == pytest.approx(grad[i], rel=2e-2, abs=2e-3), name


def test_states_carry_over_windows_and_lengths():
    rng = np.random.default_rng(2)
    p = gru.initial(rng.integers(1, 50, 128).astype(float), hidden=8)
    p["W"], p["C"] = (rng.standard_normal(p[k].shape).astype(np.float32) for k in ("W", "C"))
    texts = [rng.integers(0, 128, n) for n in (200, 1, 65, 64, 33)]
    together = gru.log_likelihood(p, texts, 0)
    for x, got in zip(texts, together, strict=True):
        h, prev, total = np.zeros((1, 8), np.float32), 0, 0.0
        for y in x:
            h = gru._states(p, np.array([[prev]]), h)[0]
            every, _ = gru._output(p, np.repeat(h, 128, 0), np.arange(128))
            assert np.exp(every).sum() == pytest.approx(1, abs=1e-3)
            total, prev = total + every[y], y
        assert got == pytest.approx(total, rel=1e-3)


def test_training_learns_a_pattern():
    rng = np.random.default_rng(3)
    texts = [np.tile([1, 2, 3, 4], 30)[k : k + 100] for k in rng.integers(0, 4, 64)]
    t = gru.Trainer(gru.initial(np.bincount(np.concatenate(texts), minlength=64).astype(float)))
    before = gru.log_likelihood(t.p, texts, 0).sum()
    for _ in range(6):
        t.train(texts, 0)
    assert gru.log_likelihood(t.p, texts, 0).sum() > 0.3 * before


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[700:850] = x[3]  # many copies of one vector
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(2000, None, "a"), (2001, [0.0] * 16, "a"), (2002, [float("nan")] + [1.0] * 15, "a"), (2003, [1.0], "a"), (None, [1.0] * 16, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    asked = df.where("vec_id % 20 = 0").select("vec_id")
    got = ann.nearest(df, asked).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 900, 20))
    m, hit = x.astype(float), 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        s = m @ m[q]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-9) for r in rs)
        order = [i for i in np.lexsort((np.arange(900), -np.round(s, 9))) if i != q][:20]
        hit += len(set(order) & {r.vec_id for r in rs})
        assert [(-round(r.score, 9), r.vec_id) for r in rs] == sorted((-round(r.score, 9), r.vec_id) for r in rs)
    assert hit / (20 * len(by)) > 0.9
    assert ann.nearest(df.where("false"), asked).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), asked).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("size", [1.0, 1e6, 1e-6])
def test_nearest_neighbours_of_isolated_points_and_large_norms(spark, monkeypatch, size):
    monkeypatch.setattr(ann, "GROUP", 32)  # many cells, as in a large table
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((4, 24))
    x = np.concatenate([centres[rng.integers(0, 4, 1500)] + 0.1 * rng.standard_normal((1500, 24)), rng.standard_normal((40, 24))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * size
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id >= 1500").select("vec_id")).collect()
    hit = 0
    for q in range(1500, 1540):
        rs = {r.vec_id for r in got if r.query_id == q}
        assert len(rs) == 20
        hit += len(rs & {i for i in np.argsort(-(x @ x[q])) if i != q and i in set(np.argsort(-(x @ x[q]))[:21])})
    assert hit / 800 > 0.9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, DATA)
        out = out.cache()
        if name != "bpe":
            assert out.columns == before.columns, name
        if name == "near_duplicates":
            assert out.count() == out.select("doc_id").distinct().count() < before.count()
    rows = out.collect()
    assert rows and all(r.decodes and r.n_tokens == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries()) == list(range(1, 11))


def test_queries_that_open_one_point_are_dealt_to_its_copies(spark, monkeypatch):
    """One vector far longer than all others is in every list: every query opens it."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((400, 6))
    v[7] *= 100
    rows = spark.createDataFrame([(i, x.tolist(), "x", 1, 2.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, p string, part int, score double")
    plain = sorted(map(tuple, ann.nearest(rows, rows.select("vec_id")).collect()))
    groups = []
    monkeypatch.setattr(ann, "HOT_ROWS", 16)
    saved = ann.saved

    def seen(spark, df, name):
        found = saved(spark, df, name)
        if name == "hot":
            groups.append(sorted((r.p, r.parts) for r in found[0].collect()))
        return found

    monkeypatch.setattr(ann, "saved", seen)
    assert sorted(map(tuple, ann.nearest(rows, rows.select("vec_id")).collect())) == plain
    assert any(parts >= 5 for found in groups for p, parts in found if p == 7)
    s = v @ v.T
    for q in range(0, 400, 20):
        want = [int(i) for i in sorted(range(400), key=lambda i: (-s[q, i], i)) if i != q][:20]
        assert [r[2] for r in plain if r[0] == q] == want


def test_few_queries_need_no_count_of_the_lists_they_open(spark, monkeypatch):
    """No list is opened by more queries than there are, so a hop of fewer than HOT_ROWS of them counts nothing."""
    v = np.random.default_rng(13).standard_normal((120, 6))
    rows, names, saved = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), [], ann.saved

    def seen(spark, df, name):
        names.append(name)
        return saved(spark, df, name)

    monkeypatch.setattr(ann, "saved", seen)
    found = ann.nearest(rows, rows.select("vec_id")).count()
    assert found == 120 * 20 and names.count("state") > 1 and "hot" not in names


def test_sums_of_the_softmax_hold_for_logits_of_any_size():
    rng = np.random.default_rng(14)
    for most in (1, gru._SAFE, 500):
        x = rng.uniform(-most, most, (50, 64)).astype(np.float32)
        x[0], own = -most, rng.integers(0, 64, 50)
        exact = x.astype(float) - np.log(np.exp(x - x.max(axis=1, keepdims=True).astype(float)).sum(axis=1, keepdims=True)) - x.max(axis=1, keepdims=True)
        p, log_p = gru._softmax(x.copy(), own, True)
        assert np.allclose(log_p, exact[np.arange(50), own], rtol=1e-5, atol=1e-4) and np.allclose(p, np.exp(exact), atol=1e-4)
        assert np.allclose(gru._summed(p), p.sum(axis=0), atol=1e-4)


def test_one_softmax_serves_all_classes_of_a_window(monkeypatch):
    """Its cost follows the tokens, not the classes; results are those of each class by itself."""
    rng, calls, softmax = np.random.default_rng(15), [], gru._softmax
    p = gru.initial(rng.integers(1, 50, 640).astype(float), hidden=8)
    p["W"], p["C"] = (rng.standard_normal(p[k].shape).astype(np.float32) for k in ("W", "C"))
    h, y = rng.standard_normal((300, 8)).astype(np.float32), rng.integers(0, 640, 300)
    monkeypatch.setattr(gru, "_softmax", lambda *a: calls.append(len(a[0])) or softmax(*a))
    grad = {}
    found, _ = gru._output(p, h, y, grad)
    assert calls == [300, 300]
    soft = lambda x: x - np.log(np.exp(x).sum())
    for i in range(300):
        k = y[i] // 64
        rows = slice(64 * k, 64 * k + 64)
        assert found[i] == pytest.approx(soft(h[i] @ p["C"] + p["c"])[k] + soft(p["W"][rows] @ h[i] + p["w"][rows])[y[i] - 64 * k], rel=1e-4)
    assert {k: grad[k].shape for k in grad} == {k: p[k].shape for k in ("C", "c", "W", "w")}
    assert (gru._order(np.array([70_000, 3, 70_000, 2]), 80_000) == [3, 1, 0, 2]).all()
