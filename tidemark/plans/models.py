"""Queries over statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.expressions import DAY_NS, ratio, signed, window_index
from tidemark.operators import attribution, dynamics, linear, protocol, representation, rollouts, stats, survival as life, time
from tidemark.plans.events import _FLOWS, _STAGES, flows, staged
from tidemark.plans.registry import Tables, normal_equations, query
from tidemark.plans.windows import WEEK, weekly
from tidemark.sources.sinks import scratch

_LONG = "lo AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) z)"
_FS = "fs AS (SELECT dim, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (WHERE v <> 0) AS nonzero, min(v) AS lo, max(v) AS hi FROM lo GROUP BY dim)"
_R = 6
_STAY = "sy AS (SELECT side, expected_tokens AS mass, arrival_ns + (2 + request_id % 9) * 86400000000000 AS a, arrival_ns + (12 + request_id % 15) * 86400000000000 AS b FROM att)"


@query(f"{_LONG}, {_FS} SELECT dim, n, round(mean, 6) AS mean, round(std, 6) AS std, nonzero, round(lo, 6) AS lo, round(hi, 6) AS hi FROM fs")
def feature_stats(t: Tables) -> DataFrame:
    return linear.feature_stats(t.embeddings, "embedding").select("dim", "n", F.round("mean", _R).alias("mean"), F.round("std", _R).alias("std"), "nonzero", F.round("lo", _R).alias("lo"), F.round("hi", _R).alias("hi"))


@query(f"{_LONG}, m AS (SELECT dim, CASE WHEN dim % 9 = 0 THEN 1.0 ELSE v END AS v FROM lo) SELECT dim, count(*) AS n FROM m GROUP BY dim HAVING min(v) = max(v)")
def constant_dims(t: Tables) -> DataFrame:
    rows = linear.long_form(t.embeddings, "embedding").withColumn("v", F.when(F.col("dim") % 9 == 0, 1.0).otherwise(F.col("v")))
    return rows.groupBy("dim").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).where("a = b").drop("a", "b")


@query(f"{_LONG} SELECT dim, round(count(*) FILTER (WHERE v > 0) / count(*), 9) AS positive, round(stddev_pop(v) / nullif(abs(avg(abs(v))), 0), 5) AS variation, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM lo GROUP BY dim")
def output_sparsity(t: Tables) -> DataFrame:
    v = F.col("v")
    rows = linear.long_form(t.embeddings, "embedding")
    plain = rows.groupBy("dim").agg(F.round(stats.share(v > 0), 9).alias("positive"), F.round(ratio(F.stddev_pop(v), F.avg(F.abs(v))), 5).alias("variation"))
    found = stats.percentiles(rows, ["dim"], "v", {"p95": 0.95, "p99": 0.99})
    return plain.join(found.select("dim", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99")), "dim")


@query(f"{_LONG} SELECT CAST(a.dim AS BIGINT) AS i, CAST(b.dim AS BIGINT) AS j, round(sum(a.v * b.v) / count(*), 6) AS g FROM lo a JOIN lo b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim")
def gram(t: Tables) -> DataFrame:
    g, n = linear.gram(t.embeddings, "embedding")
    return t.spark.createDataFrame([(i, j, float(g[i, j] / n)) for i in range(len(g)) for j in range(len(g))], "i long, j long, g double").select("i", "j", F.round("g", 6).alias("g"))


_NORM = f"{_LONG}, {_FS}, nz AS (SELECT *, dim // 16 AS block, std > greatest(1e-12, abs(mean) * 1e-10) AS active FROM fs), nw AS (SELECT *, CASE WHEN active THEN 1 / sqrt(count(*) FILTER (WHERE active) OVER (PARTITION BY block)) ELSE 0 END AS weight FROM nz)"


def normalizer(t: Tables) -> DataFrame:
    s = linear.feature_stats(t.embeddings, "embedding")
    return linear.block_normalizer(s, s.select("dim", F.expr("dim div 16").alias("block")))


_NORMED = f"{_NORM} SELECT vec_id, lo.dim, round(CASE WHEN active THEN (v - mean) / std * weight ELSE 0 END, 5) AS z FROM lo JOIN nw ON lo.dim = nw.dim"


@query(_NORMED)
def normalize_block(t: Tables) -> DataFrame:
    rows = linear.long_form(t.embeddings, "embedding", ["vec_id"])
    return linear.normalized(rows, normalizer(t), ["vec_id"]).select("vec_id", "dim", F.round("z", 5).alias("z"))


@query(_NORMED)
def normalize_block_all(t: Tables) -> DataFrame:
    """The name of the query over every vector while normalize_block had one in ten; now both have all."""
    return normalize_block(t)


@query("""ix AS (SELECT arrival_ns // 604800000000000 AS k, count(*) AS requests, sum(input_tokens) AS tokens, count(*) FILTER (WHERE side = 0) / count(*) AS share FROM att GROUP BY 1),
u AS (SELECT k, 'requests' AS unit, CAST(requests AS DOUBLE) AS v FROM ix UNION ALL SELECT k, 'tokens', CAST(tokens AS DOUBLE) FROM ix UNION ALL SELECT k, 'ratio', share FROM ix),
w AS (SELECT k, unit, CASE WHEN unit IN ('requests', 'tokens') THEN ln(1 + v) ELSE v END AS v FROM u), s AS (SELECT unit, avg(v) AS m, stddev_pop(v) AS d FROM w GROUP BY unit)
SELECT k, w.unit, round(CASE WHEN w.unit = 'ratio' THEN v ELSE (v - m) / d END, 6) AS z FROM w JOIN s ON w.unit = s.unit""")
def normalize_policy(t: Tables) -> DataFrame:
    g = t.att.groupBy(window_index("arrival_ns", WEEK).alias("k")).agg(F.count("*").cast("double").alias("requests"), F.sum("input_tokens").cast("double").alias("tokens"), F.count_if(F.col("side") == 0).alias("_a"))
    u = g.select("k", F.explode(F.create_map(F.lit("requests"), "requests", F.lit("tokens"), "tokens", F.lit("ratio"), ratio("_a", "requests"))).alias("unit", "v"))
    log = F.col("unit").isin(*linear.LOG_UNITS)
    u = u.withColumn("v", F.when(log, F.log1p("v")).otherwise(F.col("v")))
    s = u.groupBy("unit").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d"))
    return u.join(s, "unit").select("k", "unit", F.round(F.when(log, (F.col("v") - F.col("m")) / F.col("d")).otherwise(F.col("v")), 6).alias("z"))


@query("s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d FROM ev GROUP BY event_type) SELECT event_id, round((value - m) / d, 6) AS z FROM ev JOIN s ON ev.event_type = s.event_type")
def normalize_zscore(t: Tables) -> DataFrame:
    s = t.ev.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"))
    return t.ev.join(s, "event_type").select("event_id", F.round(ratio(F.col("value") - F.col("m"), "d"), 6).alias("z"))


@query("s AS (SELECT event_type, sqrt(avg(value * value)) AS d FROM ev GROUP BY event_type) SELECT event_id, round(value / d, 6) AS z FROM ev JOIN s ON ev.event_type = s.event_type")
def normalize_scale(t: Tables) -> DataFrame:
    s = t.ev.groupBy("event_type").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("d"))
    return t.ev.join(s, "event_type").select("event_id", F.round(ratio("value", "d"), 6).alias("z"))


@query(f"{_LONG} SELECT vec_id, round(sum(v * cos(dim)), 5) AS z0, round(sum(v * sin(dim)), 5) AS z1 FROM lo GROUP BY vec_id")
def project_dot(t: Tables) -> DataFrame:
    import numpy as np

    d = np.arange(len(t.embeddings.select("embedding").first()[0]))
    z = linear.projected(t.embeddings, "embedding", np.stack([np.cos(d), np.sin(d)], axis=1))
    return z.select("vec_id", F.round(F.col("z")[0], 5).alias("z0"), F.round(F.col("z")[1], 5).alias("z1"))


def _balanced(t: Tables, width: int) -> DataFrame:
    """The vectors normalised by blocks of sixteen, where they are: a scale is as wide as a vector, so none is taken apart."""
    scale = representation.scale_of(t.embeddings, "embedding", [str(i // 16) for i in range(width)])
    return t.embeddings.select(representation.matrix(scale.to, F.col("embedding")).alias("z"))


@query()
def pod_energy(t: Tables) -> DataFrame:
    """Energy captured by rank, from the spectrum of the normalised vectors."""
    width = len(t.embeddings.select("embedding").first()[0])
    found = linear.captured(linear.pod(_balanced(t, width), "z", width), [4, 16, 32, width])
    return t.spark.createDataFrame(found, "rank int, energy double, error double")


@query(f"""{_NORM}, z AS (SELECT vec_id, lo.dim, CASE WHEN active THEN (v - mean) / std * weight ELSE 0 END AS z FROM lo JOIN nw ON lo.dim = nw.dim),
g AS (SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) AS g FROM z a JOIN z b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim)
SELECT count(DISTINCT i) AS dims, round(sum(g * g) / pow(sum(g) FILTER (WHERE i = j), 2), 9) AS concentration FROM g""")
def pod_moments(t: Tables) -> DataFrame:
    """The sum of squared eigenvalues over the square of their sum, from the spectrum; SQL has them as the moments' norm and trace."""
    width = len(t.embeddings.select("embedding").first()[0])
    v = linear.pod(_balanced(t, width), "z", width).eigenvalues
    return t.spark.createDataFrame([(width, float((v**2).sum() / v.sum() ** 2))], "dims long, c double").select("dims", F.round("c", 9).alias("concentration"))


#: Of 64 components, 0 to 15 mirror 16 to 31; the others stand alone, balanced by blocks of 16.
_HALVES = f"""{_NORM}, pr AS (SELECT a.vec_id, a.dim, (a.v + b.v) / 2 AS m, (a.v - b.v) / 2 AS h FROM lo a JOIN lo b ON a.vec_id = b.vec_id AND b.dim = a.dim + 16 WHERE a.dim < 16),
ps AS (SELECT dim, avg(m) AS mm, stddev_pop(m) AS ms, avg(h) AS hm, stddev_pop(h) AS hs FROM pr GROUP BY dim),
nr AS (SELECT vec_id, 'common' AS part, 'block ' || block AS block, CASE WHEN active THEN (v - mean) / std * weight ELSE 0 END AS z FROM lo JOIN nw ON lo.dim = nw.dim WHERE lo.dim >= 32
       UNION ALL SELECT vec_id, 'common', 'means', (m - mm) / ms FROM pr JOIN ps ON pr.dim = ps.dim UNION ALL SELECT vec_id, 'difference', 'halves', (h - hm) / hs FROM pr JOIN ps ON pr.dim = ps.dim)"""


def represented(t: Tables) -> tuple[representation.Representation, list[str]]:
    """The representation of all vectors with every mode, and the blocks of the common part's components."""
    names = [f"{'a.' if i < 16 else 'b.' if i < 32 else 'c.'}{i % 16 if i < 32 else i}" for i in range(64)]
    blocks = [f"block {i // 16}" for i in range(64)]
    pairs = representation.paired(names, [("a.", "b.")])
    return representation.fit(t.embeddings, "embedding", pairs, blocks, (48, 16)), [blocks[i] for i in pairs.rest] + ["means"] * 16


@query(f"{_HALVES} SELECT vec_id, round(sum(z * z) FILTER (WHERE part = 'common'), 4) AS common, round(sum(z * z) FILTER (WHERE part = 'difference'), 4) AS difference FROM nr GROUP BY vec_id")
def frozen_encode(t: Tables) -> DataFrame:
    """Energy of each vector's coordinates by part; with all modes it is that of what is normalised, which SQL has."""
    found, _ = represented(t)
    z = t.embeddings.select("vec_id", representation.matrix(found.encode, F.col("embedding")).alias("z"))
    energy = lambda a, n: F.round(F.aggregate(F.slice("z", a, n), F.lit(0.0), lambda s, x: s + x * x), 4)
    return z.select("vec_id", energy(1, 48).alias("common"), energy(49, 16).alias("difference"))


@query(f"""{_LONG}, w AS (SELECT a.vec_id, a.dim, round(a.v, 4) AS v, round(a.v - b.v, 4) AS d FROM lo a LEFT JOIN lo b ON b.vec_id = a.vec_id AND b.dim = a.dim + 16 AND a.dim < 16)
SELECT vec_id, dim, CASE WHEN v = 0 THEN 0 ELSE v END AS v, CASE WHEN d = 0 THEN 0 ELSE d END AS difference FROM w""")
def frozen_decode(t: Tables) -> DataFrame:
    """Vectors encoded with a representation that was written and read again, and decoded: they come back whole."""
    path = scratch(t.spark, "representation")
    digest = representation.frozen(t.spark, represented(t)[0], path)
    found = representation.thawed(t.spark, path, digest)
    z = t.embeddings.select("vec_id", representation.matrix(found.encode, F.col("embedding")).alias("z"))
    back = z.select("vec_id", representation.matrix(found.decode, F.col("z")).alias("x"), representation.matrix(found.differences, F.col("z")).alias("d"))
    plain = lambda c: F.when(F.round(c, 4) == 0, 0.0).otherwise(F.round(c, 4))  # noqa: E731  # no zero below zero
    return back.select("vec_id", F.posexplode("x").alias("dim", "v"), "d").select("vec_id", "dim", plain(F.col("v")).alias("v"), plain(F.get("d", F.col("dim"))).alias("difference"))


@query(f"{_HALVES} SELECT part, block, round(sum(z * z) / count(DISTINCT vec_id), 5) AS energy FROM nr GROUP BY part, block")
def mode_shares(t: Tables) -> DataFrame:
    """Energy by block: each mode's energy times the block's share of it, over all modes."""
    found, blocks = represented(t)
    of = {"common": blocks, "difference": ["halves"] * 16}
    rows = [(part, b, float(s @ getattr(found, f"{part}_energy"))) for part, names in of.items() for b, s in found.shares(part, names).items()]
    return t.spark.createDataFrame(rows, "part string, block string, energy double").select("part", "block", F.round("energy", 5).alias("energy"))


_FAMILIES = {"low": (range(4), range(16, 20)), "mid": (range(4, 12), range(20, 28)), "one": ((12,), (28,)), "rest": (range(32, 64), ())}


@query(f"{_LONG} SELECT vec_id, " + ", ".join(f"round(coalesce(sum(v) FILTER (WHERE dim IN ({', '.join(map(str, a))})), 0) - {'coalesce(sum(v) FILTER (WHERE dim IN (' + ', '.join(map(str, b)) + ')), 0)' if b else '0'}, 5) AS {n}" for n, (a, b) in _FAMILIES.items()) + " FROM lo GROUP BY vec_id")
def descriptor_sums(t: Tables) -> DataFrame:
    """Sums of mirrored components, left less right, by family of names; the last descriptor has no right side."""
    names = [f"{'a' if i < 16 else 'b'}.{('low', 'mid', 'mid', 'one')[i % 16 // 4] if i % 16 < 13 else 'other'}.{i % 16}" if i < 32 else f"c.{i}" for i in range(64)]
    of = representation.families(names, ["low", "mid", "one"], [("a.", "b.")]) | {"rest": (list(range(32, 64)), [])}
    found = t.embeddings.select("vec_id", *representation.descriptors("embedding", of))
    return found.select("vec_id", *(F.round(c, 5).alias(c) for c in of))


@query(f"""{_STAY}, x AS (SELECT ln(1 + mass) AS f, (b - a) / 1e9 AS d FROM sy), m AS (SELECT count(*) AS n, avg(f) AS m, stddev_pop(f) AS s FROM x), y AS (SELECT (f - m) / s AS z, d, ln(1 + d) AS y, n FROM x, m),
k AS (SELECT avg(y) AS c, sum(z * y) / (count(*) + 10) AS w FROM y) SELECT round(c, 6) AS constant, round(w, 6) AS weight, round(sqrt(avg(pow(exp(c + w * z) - 1 - d, 2))) / 86400, 6) AS error_days FROM y, k GROUP BY c, w""")
def delay_kernel(t: Tables) -> DataFrame:
    """Waiting times by the logarithm of the tokens expected: log1p of seconds, standardised feature, ridge of 10."""
    rows = staged(t).select(((F.col("admission_ns") - F.col("ready_ns")) / 1e9).alias("d"), F.log1p(F.col("expected_tokens").cast("double")).alias("f"))
    kernel = dynamics.delay(rows, F.col("d"), [F.col("f")], 10.0)
    e = kernel.column([F.col("f")]) - F.col("d")
    return rows.agg(F.round(F.sqrt(F.avg(e * e)) / 86400, 6).alias("error_days")).select(F.round(F.lit(float(kernel.model.constant[0])), 6).alias("constant"), F.round(F.lit(float(kernel.model.parts["x"][0, 0])), 6).alias("weight"), "error_days")


_FORCE = f"""f AS (SELECT arrival_ns // {WEEK} AS k, CAST(2 * count(*) FILTER (WHERE side = 0) - count(*) AS DOUBLE) AS a, (2 * coalesce(sum(expected_tokens) FILTER (WHERE side = 0), 0) - sum(expected_tokens)) / 1000.0 AS b FROM att GROUP BY 1),
y AS (SELECT a, b, lead(a) OVER (ORDER BY k) - a AS ya, lead(b) OVER (ORDER BY k) - b AS yb FROM f), m AS (SELECT sum(a * a) + 2 AS aa, sum(a * b) AS ab, sum(b * b) + 2 AS bb, sum(a * ya) AS pa, sum(b * ya) AS qa, sum(a * yb) AS pb, sum(b * yb) AS qb FROM y WHERE ya IS NOT NULL)"""


@query(f"""{_FORCE} SELECT round((bb * pa - ab * qa) / (aa * bb - ab * ab), 6) AS a_to_a, round((aa * qa - ab * pa) / (aa * bb - ab * ab), 6) AS b_to_a, round((bb * pb - ab * qb) / (aa * bb - ab * ab), 6) AS a_to_b, round((aa * qb - ab * pb) / (aa * bb - ab * ab), 6) AS b_to_b FROM m""")
def conservation_model(t: Tables) -> DataFrame:
    """The inflow-only model of imbalances: no intercept, ridge of 2."""
    g = t.att.groupBy(window_index("arrival_ns", WEEK).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("na"), F.sum("expected_tokens").alias("m"), F.sum(F.when(F.col("side") == 0, F.col("expected_tokens")).otherwise(0)).alias("ma"))
    f = g.select("k", F.array(signed("n", "na").cast("double"), signed("m", "ma") / 1000.0).alias("f")).withColumn("after", F.lead("f").over(W.orderBy("k")))  # one row for each week
    rows = f.where("after is not null")
    theta = dynamics.fitted(rows, dynamics.conservation("f", "f"), dynamics.minus(F.col("after"), F.col("f")), 2.0, intercept=False).parts["forcing"]
    names = ("a_to_a", "b_to_a", "a_to_b", "b_to_b")
    return t.spark.createDataFrame([tuple(float(theta[i, j]) for j in (0, 1) for i in (0, 1))], ", ".join(f"{n} double" for n in names)).select(*(F.round(n, 6).alias(n) for n in names))


@query(f"""{_FORCE}, e AS (SELECT ya - (a * (bb * pa - ab * qa) + b * (aa * qa - ab * pa)) / (aa * bb - ab * ab) AS e, ya FROM y, m WHERE ya IS NOT NULL) SELECT count(*) AS n, round(sqrt(sum(e * e) / sum(ya * ya)), 9) AS nrmse FROM e""")
def conservation_error(t: Tables) -> DataFrame:
    """One-step error of the same model's first output."""
    g = t.att.groupBy(window_index("arrival_ns", WEEK).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("side") == 0).alias("na"), F.sum("expected_tokens").alias("m"), F.sum(F.when(F.col("side") == 0, F.col("expected_tokens")).otherwise(0)).alias("ma"))
    f = g.select("k", F.array(signed("n", "na").cast("double"), signed("m", "ma") / 1000.0).alias("f")).withColumn("after", F.lead("f").over(W.orderBy("k")))
    rows = f.where("after is not null").withColumn("y", dynamics.minus(F.col("after"), F.col("f")))
    model = dynamics.fitted(rows, dynamics.conservation("f", "f"), F.col("y"), 2.0, intercept=False)
    predicted = model.column(dynamics.conservation("f", "f"))
    return rows.select(F.col("y")[0].alias("y"), predicted[0].alias("p")).agg(F.count("*").alias("n"), F.round(stats.nrmse(F.col("y"), F.col("p")), 9).alias("nrmse"))


#: Weekly arrivals of each run with tokens as disturbance and a stepped control; a row joined to the row before it.
_STEP = f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, ln(1 + count(*)) AS z, ln(1 + sum(input_tokens)) AS d, (arrival_ns // {WEEK} // 7) % 3 * 0.2 + 0.3 AS u FROM att GROUP BY run, arrival_ns // {WEEK}),
tr AS (SELECT *, lag(z) OVER w AS zb, lag(d) OVER w AS db, lead(z) OVER w AS y, row_number() OVER w AS i FROM wk WINDOW w AS (PARTITION BY run ORDER BY k)),
st2 AS (SELECT run, k, i, z, zb, z - zb AS dz, d, db, CAST(u AS DOUBLE) AS u, z * u AS zu, 1.0 AS one, y FROM tr WHERE i > 1), fit AS (SELECT * FROM st2 WHERE y IS NOT NULL)"""


def _stepped(t: Tables) -> DataFrame:
    w = W.partitionBy("run").orderBy("k")
    rows = weekly(t).select("run", "k", F.array(F.log1p("n")).alias("z"), F.array(F.log1p("tokens")).alias("d"), F.array((F.expr("k div 7") % 3 * 0.2 + 0.3).cast("double")).alias("u"), F.array(F.lead(F.log1p("n")).over(w)).alias("y"))
    return dynamics.transitions(rows, "run", "k", ["z", "d"])


@query(f"""{_STEP}, {normal_equations("fit", ["z", "dz", "d", "db", "u", "zu", "one"], ["y"], 1.0, 1)},
e AS (SELECT y, z * b0_0 + dz * b1_0 + d * b2_0 + db * b3_0 + u * b4_0 + zu * b5_0 + b6_0 AS p FROM fit, th), r AS (SELECT b0_0 + b1_0 + 0.5 * b5_0 AS p, -b1_0 AS q FROM th)
SELECT count(*) AS n, round(sqrt(sum((y - p) * (y - p)) / greatest(sum(y * y), 1e-30)), 6) AS nrmse,
       (SELECT round(CASE WHEN p * p + 4 * q >= 0 THEN (abs(p) + sqrt(greatest(p * p + 4 * q, 0))) / 2 ELSE sqrt(greatest(-q, 0)) END, 6) FROM r) AS radius FROM e""")
def dynamic_model(t: Tables) -> DataFrame:
    """Bilinear, one step ahead; SQL has the spectral radius at a control of 0.5 by the roots of the state's two lags."""
    rows = _stepped(t).where("y[0] is not null")
    blocks = dynamics.dynamics("z", "d", "u", bilinear=True)
    model = dynamics.fitted(rows, blocks, F.col("y"), 1.0)
    return rows.select(F.col("y")[0].alias("y"), model.column(blocks)[0].alias("p")).agg(F.count("*").alias("n"), F.round(stats.nrmse(F.col("y"), F.col("p")), 6).alias("nrmse")).withColumn("radius", F.lit(round(dynamics.dynamic_radius(model, 0.5), 6)))


#: The model's own free run from each run's second week, row by row.
_FREE = f"""{_STEP}, {normal_equations("fit", ["z", "dz", "d", "db", "u", "one"], ["y"], 1.0, 1)},
fr AS (SELECT * FROM (WITH RECURSIVE walk AS (
    SELECT run, i, z AS p, zb AS pb FROM st2 WHERE i = 2
    UNION ALL SELECT w.run, s.i + 1, w.p * b0_0 + (w.p - w.pb) * b1_0 + s.d * b2_0 + s.db * b3_0 + s.u * b4_0 + b5_0, w.p FROM walk w JOIN st2 s ON s.run = w.run AND s.i = w.i, th)
    SELECT * FROM walk))"""


def _rolled(t: Tables) -> DataFrame:
    """(run, k, z, predicted, first) of the free run."""
    rows = _stepped(t)
    model = dynamics.fitted(rows.where("y[0] is not null"), dynamics.dynamics("z", "d", "u"), F.col("y"), 1.0)
    columns = {"d": F.col("d"), "d_before": F.col("d_before"), "u": F.col("u")}
    found = rollouts.free(rows, "run", "k", rollouts.lagged(model), columns, F.concat("z", "z_before"))
    return rows.select("run", "k", "z", F.first("z").over(W.partitionBy("run").orderBy("k").rowsBetween(W.unboundedPreceding, 0)).alias("first")).join(found, ["run", "k"])


@query(f"{_FREE} SELECT st2.run, st2.k, round(p, 6) AS predicted FROM fr JOIN st2 ON st2.run = fr.run AND st2.i = fr.i")
def lag_rollout(t: Tables) -> DataFrame:
    """A fitted model with lag, disturbances and control, run freely through each run."""
    return _rolled(t).select("run", "k", F.round(F.col("predicted")[0], 6).alias("predicted"))


@query(f"""{_FREE}, x AS (SELECT st2.run, st2.z AS a, fr.p, first_value(st2.z) OVER (PARTITION BY st2.run ORDER BY st2.i) AS h FROM fr JOIN st2 ON st2.run = fr.run AND st2.i = fr.i),
g AS (SELECT run, count(*) AS n, sqrt(sum((a - p) * (a - p)) / greatest(sum(a * a), 1e-30)) AS e, sqrt(sum((a - h) * (a - h)) / greatest(sum(a * a), 1e-30)) AS s FROM x GROUP BY run)
SELECT run, n, round(e, 6) AS nrmse, round(s, 6) AS persistence, round(CASE WHEN s > 0 THEN 1 - e / s END, 5) AS skill FROM g""")
def rollout_skill(t: Tables) -> DataFrame:
    """The free run's error and what it saves of the error of standing still, by run."""
    return rollouts.evaluated(_rolled(t), ["run"], "z", "predicted", "first").select("run", "n", F.round("nrmse", 6).alias("nrmse"), F.round("persistence", 6).alias("persistence"), F.round("skill", 5).alias("skill"))


_FLOW_ROWS = f"""fx AS (SELECT side, k, CAST(count(*) FILTER (WHERE flow = 'kv_ready') AS DOUBLE) AS i, CAST(count(*) FILTER (WHERE flow = 'admission') AS DOUBLE) AS y FROM fl WHERE flow IN ('kv_ready', 'admission') GROUP BY side, k),
fw AS (SELECT side, k, i, y, coalesce(sum(i - y) OVER (PARTITION BY side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM fx),
ft AS (SELECT *, sum(s) OVER (PARTITION BY k) AS ts, sum(i) OVER (PARTITION BY k) AS ti FROM fw),
fd AS (SELECT {", ".join(f"CASE WHEN stddev_pop({c}) < 1e-12 THEN 1 ELSE stddev_pop({c}) END AS d{c}" for c in ("s", "i", "ts", "ti", "y"))} FROM ft),
fs AS (SELECT s, i, y, s / ds AS xs, i / di AS xi, ts / dts AS xts, ti / dti AS xti, y / dy AS xy, dy FROM ft, fd)"""


@query(f"""{_STAGES}, {_FLOWS}, {_FLOW_ROWS}, {normal_equations("fs", ["xs", "xi", "xts", "xti"], ["xy"], 1.0)},
p AS (SELECT y, least(greatest((xs * b0_0 + xi * b1_0 + xts * b2_0 + xti * b3_0) * dy, 0), greatest(s + i, 0)) AS p, greatest(s + i, 0) AS most FROM fs, th)
SELECT count(*) AS n, round(sqrt(sum((y - p) * (y - p)) / greatest(sum(y * y), 1e-30)), 6) AS nrmse, count(*) FILTER (WHERE p < 0 OR p > most) AS beyond FROM p""")
def flow_model(t: Tables) -> DataFrame:
    """Admissions of each side by what waits and what becomes ready, on both sides."""
    rows = _flow_rows(t)
    found = dynamics.flow(rows, "s", "i", "ts", "ti", "y", 1.0)
    p = found.column(*(F.col(c) for c in ("s", "i", "ts", "ti")))[0]
    return rows.select(F.col("y")[0].alias("y"), p.alias("p"), (F.col("s")[0] + F.col("i")[0]).alias("most")).agg(F.count("*").alias("n"), F.round(stats.nrmse(F.col("y"), F.col("p")), 6).alias("nrmse"), F.count_if((F.col("p") < 0) | (F.col("p") > F.greatest("most", F.lit(0.0)))).alias("beyond"))


def _flow_rows(t: Tables, inflow: str = "kv_ready", outflow: str = "admission") -> DataFrame:
    """(side, k, s, i, ts, ti, y): what a stage has and gets, on this side and on both, and what leaves it."""
    w = flows(t).where(F.col("flow").isin(inflow, outflow)).groupBy("side", "k").pivot("flow", [inflow, outflow]).agg(F.sum("n")).fillna(0)
    stock = F.sum(F.col(inflow) - F.col(outflow)).over(W.partitionBy("side").orderBy("k").rowsBetween(W.unboundedPreceding, -1))
    own = w.withColumn("stock", F.coalesce(stock, F.lit(0)))
    total = own.groupBy("k").agg(F.sum("stock").alias("ts"), F.sum(inflow).alias("ti"))
    one = lambda c: F.array(F.col(c).cast("double"))
    return own.join(total, "k").select("side", "k", one("stock").alias("s"), one(inflow).alias("i"), one("ts").alias("ts"), one("ti").alias("ti"), one(outflow).alias("y"))


@query()
def flow_rollout(t: Tables) -> DataFrame:
    """Three stages run freely on what is routed: fitted flows, clipped to what there is. Tests hold it against a walk in numpy."""
    chain = ("route", "kv_ready", "admission", "terminal")
    models = [dynamics.flow(_flow_rows(t, a, b), "s", "i", "ts", "ti", "y", 1.0) for a, b in zip(chain[:-1], chain[1:], strict=True)]
    routed = flows(t).where("flow = 'route'").groupBy("k").pivot("side", [0, 1]).agg(F.sum("n")).fillna(0)
    rows = routed.select(F.lit("all").alias("run"), "k", F.array(F.col("0").cast("double"), F.col("1").cast("double")).alias("inflow"), F.array_repeat(F.lit(0.0), 6).alias("start"))
    found = rollouts.flow_rollout(rows, "run", "k", "inflow", "start", models)
    names = [f"{stage}_{side}" for stage in ("handoff", "waiting", "running") for side in (0, 1)]
    return found.select("k", *(F.round(F.col("stocks")[i], 6).alias(n) for i, n in enumerate(names)))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, CAST(count(*) AS DOUBLE) AS n FROM att GROUP BY ALL), p AS (SELECT n AS x, lead(n) OVER (PARTITION BY run ORDER BY k) AS y FROM wk), q AS (SELECT x, y FROM p WHERE y IS NOT NULL),
m AS (SELECT count(*) AS c, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM q)
SELECT round((sxy - sx * sy / c) / (sxx - sx * sx / c + 10), 6) AS slope, round((sy - (sxy - sx * sy / c) / (sxx - sx * sx / c + 10) * sx) / c, 5) AS intercept FROM m""")
def ridge_moments(t: Tables) -> DataFrame:
    m = linear.ridge(_steps(t), "x", "y", 10.0)
    return t.spark.createDataFrame([(float(m.theta[1, 0]), float(m.theta[0, 0]))], "slope double, intercept double").select(F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


def _steps(t: Tables) -> DataFrame:
    y = F.lead("n").over(W.partitionBy("run").orderBy("k"))
    return weekly(t).withColumn("y", y).where("y is not null").select("run", "k", F.array(F.col("n").cast("double")).alias("x"), F.array(F.col("y").cast("double")).alias("y"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, CAST(count(*) AS DOUBLE) AS n FROM att GROUP BY ALL), p AS (SELECT run, n AS x, lead(n) OVER (PARTITION BY run ORDER BY k) AS y FROM wk)
SELECT run, count(*) AS n, round(sqrt(sum((y - x) * (y - x)) / greatest(sum(y * y), 1e-30)), 9) AS persistence FROM p WHERE y IS NOT NULL GROUP BY run""")
def one_step_nrmse(t: Tables) -> DataFrame:
    return _steps(t).groupBy("run").agg(F.count("*").alias("n"), F.round(stats.nrmse(F.col("y")[0], F.col("x")[0]), 9).alias("persistence"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (PARTITION BY run ORDER BY arrival_ns // {WEEK}) AS i FROM att GROUP BY run, arrival_ns // {WEEK}),
f AS (SELECT run, n FROM wk WHERE i = 1)
SELECT wk.run, wk.k, round(pow(CAST(0.9 AS DOUBLE), i - 1) * f.n + 2 * (1 - pow(CAST(0.9 AS DOUBLE), i - 1)) / CAST(0.1 AS DOUBLE), 6) AS predicted FROM wk JOIN f ON wk.run = f.run""")
def rollout(t: Tables) -> DataFrame:
    """A free run of n+ = 0.9 n + 2 in each run."""
    import numpy as np

    rows = weekly(t).select("run", "k", F.array(F.col("n").cast("double")).alias("z"))
    return linear.rollout(rows, "run", "k", "z", None, linear.Ridge(np.array([[2.0], [0.9]]))).select("run", "k", F.round(F.col("predicted")[0], 6).alias("predicted"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n, sum(input_tokens) AS m FROM att GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i FROM wk)
SELECT run, i // 5 AS block, round(avg(n), 6) AS n, round(avg(m), 5) AS tokens FROM r GROUP BY 1, 2 HAVING count(*) = 5""")
def slow_features(t: Tables) -> DataFrame:
    return time.block_sum(weekly(t), ["run"], "k", 5, ["n", "tokens"]).select("run", "block", F.round(F.col("n") / 5, 6).alias("n"), F.round(F.col("tokens") / 5, 5).alias("tokens"))


@query("SELECT workload, run, input_tokens AS p50 FROM (SELECT workload, run, input_tokens, row_number() OVER (PARTITION BY workload, run ORDER BY input_tokens) - 1 AS i, count(*) OVER (PARTITION BY workload, run) AS n FROM att) z WHERE i = floor((n - 1) * 0.5)")
def pct_floor_index(t: Tables) -> DataFrame:
    return stats.pct_floor_by(t.att, ["workload", "run"], "input_tokens", [0.5], ["p50"])


@query("SELECT workload, round(quantile_cont(input_tokens, 0.5), 6) AS p50, round(quantile_cont(input_tokens, 0.95), 6) AS p95 FROM att GROUP BY workload")
def pct_linear(t: Tables) -> DataFrame:
    return stats.percentiles(t.att, ["workload"], "input_tokens", {"p50": 0.5, "p95": 0.95}).select("workload", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


_EVEN = "round_even({x}, 3)"


@query(f"""x AS (SELECT event_type, CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS v FROM ev)
SELECT event_type, count(v) AS n, {_EVEN.format(x="avg(v)")} AS avg, {", ".join(f"{_EVEN.format(x=f'quantile_cont(v, {q})')} AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))}, {_EVEN.format(x="max(v)")} AS max FROM x GROUP BY event_type""")
def stats_bundle(t: Tables) -> DataFrame:
    bad = F.when(F.col("event_id") % 40 == 0, float("nan")).when(F.col("event_id") % 20 == 0, float("inf")).otherwise(F.col("value"))
    return stats.bundle(t.ev.withColumn("v", bad), ["event_type"], "v")


_GE = "er AS (SELECT workload, status, side, run, CAST(input_tokens AS DOUBLE) AS y, CAST(expected_tokens * 10 AS DOUBLE) AS p FROM att)"


@query(f"""{_GE}
SELECT coalesce(workload, '*') AS workload, coalesce(status, '*') AS status, coalesce(CAST(side AS VARCHAR), '*') AS side, coalesce(CAST(run AS VARCHAR), '*') AS run, count(*) AS n, round(sqrt(sum((y - p) * (y - p)) / sum(y * y)), 9) AS nrmse
FROM er GROUP BY GROUPING SETS ((workload), (status), (side), (run))""")
def group_errors(t: Tables) -> DataFrame:
    y, p = F.col("input_tokens").cast("double"), (F.col("expected_tokens") * 10).cast("double")
    dims = ["workload", "status", "side", "run"]
    rows = t.att.select(*(F.col(d).cast("string").alias(d) for d in dims), y.alias("y"), p.alias("p"))
    g = rows.groupingSets([[F.col(d)] for d in dims], *map(F.col, dims)).agg(F.count("*").alias("n"), F.round(stats.nrmse(F.col("y"), F.col("p")), 9).alias("nrmse"))
    return g.select(*(F.coalesce(d, F.lit("*")).alias(d) for d in dims), "n", "nrmse")


@query("""x AS (SELECT run, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b, avg(input_tokens) FILTER (WHERE side = 0) AS ma, avg(input_tokens) FILTER (WHERE side = 1) AS mb, var_samp(input_tokens) FILTER (WHERE side = 0) AS va, var_samp(input_tokens) FILTER (WHERE side = 1) AS vb FROM att GROUP BY run)
SELECT run, a AS n_low, b AS n_high, CASE WHEN a >= 2 AND b >= 2 THEN round((mb - ma) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2)), 6) END AS effect FROM x""")
def cohen_d(t: Tables) -> DataFrame:
    return stats.cohen_d(t.att, ["run"], "side", "input_tokens", 0, 1).select("run", "n_low", "n_high", F.round("effect", 6).alias("effect"))


@query("SELECT workload, round(avg(input_tokens), 6) AS mean, round(stddev_pop(input_tokens), 5) AS std, count(*) AS n FROM att GROUP BY workload")
def level_stats(t: Tables) -> DataFrame:
    return t.att.groupBy("workload").agg(F.round(F.avg("input_tokens"), 6).alias("mean"), F.round(F.stddev_pop("input_tokens"), 5).alias("std"), F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN min(k) < max(k) AND min(value) < max(value) THEN round(corr(k, value), 6) END AS r FROM ev GROUP BY event_type")
def pearson(t: Tables) -> DataFrame:
    return t.ev.groupBy("event_type").agg(F.round(stats.pearson("k", "value"), 6).alias("r"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n FROM att GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM wk)
SELECT run, round(regr_slope(n, k), 6) AS slope, count(*) AS samples FROM r WHERE i >= c // 2 GROUP BY run""")
def backlog_trend(t: Tables) -> DataFrame:
    w = W.partitionBy("run")
    late = weekly(t).withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("c", F.count("*").over(w)).where("i >= c div 2")
    return late.groupBy("run").agg(F.round(F.regr_slope("n", "k"), 6).alias("slope"), F.count("*").alias("samples"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n FROM att GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY run) AS c FROM wk),
h AS (SELECT *, i - c // 2 AS j, c - c // 2 AS m FROM r WHERE i >= c // 2)
SELECT run, round(avg(n) FILTER (WHERE j >= m - greatest(m // 4, 1)) - avg(n) FILTER (WHERE j < greatest(m // 4, 1)), 6) AS growth FROM h GROUP BY run""")
def backlog_growth(t: Tables) -> DataFrame:
    """Of the second half of a run's samples: the mean of the last quarter less that of the first."""
    w = W.partitionBy("run")
    r = weekly(t).withColumn("i", F.row_number().over(w.orderBy("k")) - 1).withColumn("c", F.count("*").over(w)).withColumn("j", F.col("i") - F.expr("c div 2")).withColumn("m", F.col("c") - F.expr("c div 2")).where("j >= 0")
    q = F.greatest(F.expr("m div 4"), F.lit(1))
    return r.groupBy("run").agg(F.round(F.avg(F.when(F.col("j") >= F.col("m") - q, F.col("n"))) - F.avg(F.when(F.col("j") < q, F.col("n"))), 6).alias("growth"))


_LEVELS = [["workload", "status", "side"], ["workload", "status"], ["workload"], []]


@query("""SELECT a.request_id, round(coalesce(m0, m1, m2, m3), 6) AS predicted FROM att a
LEFT JOIN (SELECT workload, status, side, quantile_cont(input_tokens, 0.5) AS m0 FROM att WHERE client % 5 = 0 AND side = 0 GROUP BY ALL) x ON a.workload = x.workload AND a.status = x.status AND a.side = x.side
LEFT JOIN (SELECT workload, status, quantile_cont(input_tokens, 0.5) AS m1 FROM att WHERE client % 5 = 0 AND side = 0 GROUP BY ALL) y ON a.workload = y.workload AND a.status = y.status
LEFT JOIN (SELECT workload, quantile_cont(input_tokens, 0.5) AS m2 FROM att WHERE client % 5 = 0 AND side = 0 GROUP BY ALL) z ON a.workload = z.workload, (SELECT quantile_cont(input_tokens, 0.5) AS m3 FROM att WHERE client % 5 = 0 AND side = 0) o""")
def stratified_median(t: Tables) -> DataFrame:
    medians = stats.stratified_median(t.att.where("client % 5 = 0 and side = 0"), "input_tokens", _LEVELS)
    return stats.with_fallback(t.att, medians, _LEVELS).select("request_id", F.round("predicted", 6).alias("predicted"))


@query("""q AS (SELECT workload, run, expected_tokens, row_number() OVER (PARTITION BY run ORDER BY expected_tokens) - 1 AS i, count(*) OVER (PARTITION BY run) AS n, status, side FROM att)
SELECT run, max(n) AS requests, count(*) FILTER (WHERE side = 0) AS backend_0, round(count(*) FILTER (WHERE status = 'P') / count(*), 9) AS rejected, max(expected_tokens) FILTER (WHERE i = floor((n - 1) * CAST(0.5 AS DOUBLE))) AS p50, max(expected_tokens) FILTER (WHERE i = floor((n - 1) * CAST(0.95 AS DOUBLE))) AS p95, max(expected_tokens) FILTER (WHERE i = floor((n - 1) * CAST(0.99 AS DOUBLE))) AS p99 FROM q GROUP BY run""")
def run_metrics(t: Tables) -> DataFrame:
    p = stats.pct_floor_by(t.att, ["run"], "expected_tokens", [0.5, 0.95, 0.99], ["p50", "p95", "p99"])
    g = t.att.groupBy("run").agg(F.count("*").alias("requests"), F.count_if(F.col("side") == 0).alias("backend_0"), F.round(stats.share(F.col("status") == "P"), 9).alias("rejected"))
    return g.join(p, "run")


@query(f"""c AS (SELECT run, min(arrival_ns) AS a, max(arrival_ns) AS b FROM att WHERE status = 'P' GROUP BY run), s AS (SELECT c.run, e.n FROM c JOIN em e ON e.ts_ns >= c.a AND e.ts_ns < c.b AND e.ts_ns // {WEEK} % 2 = 0 WHERE e.component = 'prefill')
SELECT run, count(*) AS samples, round(count(*) FILTER (WHERE n > 40) / count(*), 9) AS above, max(n) AS peak FROM s GROUP BY run""")
def case_summary(t: Tables) -> DataFrame:
    """Samples within the time range of each case: ranges are few and become windows, samples meet them by window."""
    cases = t.att.where("status = 'P'").groupBy("run").agg(F.min("arrival_ns").alias("a"), F.max("arrival_ns").alias("b"))
    weeks = cases.select("run", "a", "b", F.explode(F.sequence(window_index("a", WEEK), window_index("b", WEEK))).alias("w"))
    samples = t.em.where("component = 'prefill'").withColumn("w", window_index("ts_ns", WEEK)).where("w % 2 = 0")
    return samples.join(weeks, "w").where("ts_ns >= a and ts_ns < b").groupBy("run").agg(F.count("*").alias("samples"), F.round(stats.share(F.col("n") > 40), 9).alias("above"), F.max("n").alias("peak"))


@query(f"SELECT run, arrival_ns // {WEEK} AS k, round(count(*) / 7.0, 6) AS rate, count(*) FILTER (WHERE status = 'P') > 0 AS valid, round(sum(input_tokens) FILTER (WHERE status = 'P') / nullif(count(*) FILTER (WHERE status = 'P'), 0), 6) AS mean FROM att GROUP BY ALL")
def derived_kpi(t: Tables) -> DataFrame:
    p = F.col("status") == "P"
    return t.att.groupBy("run", window_index("arrival_ns", WEEK).alias("k")).agg(F.round(F.count("*") / 7.0, 6).alias("rate"), (F.count_if(p) > 0).alias("valid"), F.round(ratio(F.sum(F.when(p, F.col("input_tokens"))), F.count_if(p)), 6).alias("mean"))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n FROM att GROUP BY ALL),
r AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY k) - 1 AS i, CASE (k // 7) % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 ELSE 0.7 END AS u, CAST(n AS DOUBLE) AS v FROM wk),
c AS (SELECT run, i, old, u FROM (SELECT *, lag(u) OVER (PARTITION BY run ORDER BY i) AS old FROM r) z WHERE abs(u - old) > 1e-12),
e AS (SELECT *, least(coalesce(lead(i) OVER (PARTITION BY run ORDER BY i), (SELECT max(r.i) + 1 FROM r WHERE r.run = c.run)), i + 13) AS stop FROM c),
p AS (SELECT e.run, e.i AS "at", old, e.u, stop, (SELECT avg(v) FROM r WHERE r.run = e.run AND r.i IN (e.i - 2, e.i - 1)) AS b, (SELECT avg(v) FROM r WHERE r.run = e.run AND r.i >= greatest(e.i, stop - 3) AND r.i < stop) AS t FROM e WHERE e.i >= 2 AND stop - e.i >= 2),
q AS (SELECT *, t - b AS a FROM p)
SELECT run, "at", CAST(old AS DOUBLE) AS old_u, CAST(u AS DOUBLE) AS new_u, round(b, 6) AS baseline, round(t, 6) AS plateau, round(a, 6) AS amplitude, a * sign(u - old) > 0 AS direction_correct,
       CASE WHEN abs(a) > 1e-12 THEN (SELECT min(r.i - q."at") * CAST(5 AS DOUBLE) FROM r WHERE r.run = q.run AND r.i >= q."at" AND r.i < stop AND (v - (b + 0.2 * a)) * a >= 0) END AS response_delay,
       CASE WHEN abs(a) > 1e-12 THEN (SELECT min(o.i - q."at") * CAST(5 AS DOUBLE) FROM r o WHERE o.run = q.run AND o.i >= q."at" AND o.i <= stop - 2 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.run = q.run AND x.i >= o.i AND x.i < stop AND abs(x.v - t) > greatest(abs(a) * 0.2, 1e-9))) END AS settling_time FROM q""")
def step_response(t: Tables) -> DataFrame:
    """Responses of weekly arrivals to a control that changes every seven weeks."""
    rows = weekly(t).withColumn("u", F.element_at(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7)), (F.expr("k div 7") % 3 + 1).cast("int")))
    found = stats.steps(rows, ["run"], "k", "u", "n")
    return found.select(*(F.round(c, _R).alias(c) if c in ("baseline", "plateau", "amplitude") else F.col(c) for c in found.columns))


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, CASE WHEN arrival_ns // {WEEK} % 6 = 0 THEN NULL ELSE count(*) END AS v FROM att GROUP BY run, arrival_ns // {WEEK}) SELECT run, k // 10 AS block, round(avg(v), 6) AS mean, count(v) AS n FROM wk GROUP BY ALL""")
def slow_mean(t: Tables) -> DataFrame:
    v = F.when(F.col("k") % 6 == 0, float("nan")).otherwise(F.col("n").cast("double"))
    return weekly(t).groupBy("run", window_index("k", 10).alias("block")).agg(F.round(F.avg(stats.finite(v)), 6).alias("mean"), F.count(stats.finite(v)).alias("n"))


_EDGES = [0, 2, 5, 9, float("inf")]


@query(f"""{_STAY}, n AS (SELECT side, mass, greatest(CAST(ceil((b - a) / {float(DAY_NS)}) AS BIGINT), 1) AS n FROM sy), g AS (SELECT side, mass, n, unnest(generate_series(0, n - 1)) AS s FROM n),
h AS (SELECT side, CASE WHEN s < 2 THEN 0 WHEN s < 5 THEN 1 WHEN s < 9 THEN 2 ELSE 3 END AS bin, count(*) AS risk, count(*) FILTER (WHERE s = n - 1) AS exits, sum(mass) AS mr, coalesce(sum(mass) FILTER (WHERE s = n - 1), 0) AS mx FROM g GROUP BY ALL)
SELECT side, bin, risk, exits, round((exits + 0.5) / (risk + 1.0), 9) AS hazard, round((mx + 0.5) / (mr + 1.0), 9) AS mass_hazard FROM h""")
def hazard(t: Tables) -> DataFrame:
    h = life.hazard(staged(t), ["side"], "ready_ns", "admission_ns", "expected_tokens", _EDGES, DAY_NS, 0.5)
    return h.select("side", "bin", "risk", "exits", F.round("hazard", 9).alias("hazard"), F.round("mass_hazard", 9).alias("mass_hazard"))


@query(f"{_STAY} SELECT side, age, round(count(*) FILTER (WHERE (b - a) / {float(DAY_NS)} > age) / count(*), 9) AS alive FROM sy, (SELECT unnest(generate_series(0, 25)) AS age) g GROUP BY side, age")
def survival(t: Tables) -> DataFrame:
    return life.survival(staged(t), ["side"], "ready_ns", "admission_ns", DAY_NS, 25).select("side", "age", F.round("alive", 9).alias("alive"))


@query(f"{_STAY} SELECT side, count(*) AS n, round(quantile_cont((b - a) / {float(DAY_NS)}, 0.75), 6) AS p75, round(quantile_cont((b - a) / {float(DAY_NS)}, 0.95), 6) AS p95, round(avg((b - a) / {float(DAY_NS)}), 6) AS mean FROM sy GROUP BY side")
def dwell_audit(t: Tables) -> DataFrame:
    rows = staged(t).withColumn("d", (F.col("admission_ns") - F.col("ready_ns")) / float(DAY_NS))
    plain = rows.groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"))
    found = stats.percentiles(rows, ["side"], "d", {"p75": 0.75, "p95": 0.95})
    return plain.join(found.select("side", F.round("p75", 6).alias("p75"), F.round("p95", 6).alias("p95")), "side")


@query(f"""{_STAY}, x AS (SELECT side, a, unnest(generate_series((a + {WEEK - 1}) // {WEEK}, (b + {WEEK - 1}) // {WEEK} - 1)) AS k FROM sy WHERE (a + {WEEK - 1}) // {WEEK} < (b + {WEEK - 1}) // {WEEK})
SELECT side, k, CASE WHEN (k * {WEEK} - a) / {float(WEEK)} < 0.5 THEN 0 WHEN (k * {WEEK} - a) / {float(WEEK)} < 1 THEN 1 ELSE 2 END AS bin, count(*) AS n FROM x GROUP BY ALL""")
def age_hist(t: Tables) -> DataFrame:
    return life.age_histogram(staged(t), ["side"], "ready_ns", "admission_ns", [0, 0.5, 1, float("inf")], WEEK, 0, 1 << 40)


@query("""c AS (SELECT workload, side, count(*) AS rank, round(avg(expected_tokens), 6) AS error FROM att GROUP BY ALL), b AS (SELECT workload, min(error) AS best FROM c GROUP BY workload)
SELECT workload, side, rank, error FROM (SELECT c.*, row_number() OVER (PARTITION BY c.workload ORDER BY rank, error, side) AS r FROM c JOIN b ON c.workload = b.workload WHERE error <= best + 2.0) z WHERE r = 1""")
def parsimonious_select(t: Tables) -> DataFrame:
    c = t.att.groupBy("workload", "side").agg(F.count("*").alias("rank"), F.round(F.avg("expected_tokens"), 6).alias("error"))
    band = c.withColumn("best", F.min("error").over(W.partitionBy("workload"))).where("error <= best + 2.0")
    return band.groupBy("workload").agg(F.min(F.struct("rank", "error", "side")).alias("x")).select("workload", "x.side", "x.rank", "x.error")


@query("""SELECT run, count(*) >= 100 AS enough, max(input_tokens) <= 5000 AS bounded, count(*) FILTER (WHERE expected_tokens < 0) = 0 AS nonnegative, count(*) >= 100 AND max(input_tokens) <= 5000 AND count(*) FILTER (WHERE expected_tokens < 0) = 0 AS ready FROM att GROUP BY run""")
def gate_table(t: Tables) -> DataFrame:
    g = t.att.groupBy("run").agg((F.count("*") >= 100).alias("enough"), (F.max("input_tokens") <= 5000).alias("bounded"), (F.count_if(F.col("expected_tokens") < 0) == 0).alias("nonnegative"))
    checks = [F.coalesce(c, F.lit(False)) for c in ("enough", "bounded", "nonnegative")]
    return g.withColumn("ready", checks[0] & checks[1] & checks[2])  # what is unknown fails


@query("SELECT workload, run, count(DISTINCT status) AS levels, count(*) AS n, count(DISTINCT status) >= 3 AS excited FROM att GROUP BY workload, run HAVING count(*) >= 5")
def authority_groups(t: Tables) -> DataFrame:
    levels = F.collect_set("status")
    g = t.att.groupBy("workload", "run").agg(F.countDistinct("status").alias("levels"), F.count("*").alias("n"), levels.alias("_s")).where("n >= 5")
    wanted = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return g.select("workload", "run", "levels", "n", (F.size(F.array_except(wanted, "_s")) == 0).alias("excited"))




#: Hazards by age in days of two stages, and what is left of a cohort at each age; from age 9 on the hazard stays the same.
_AGES = 9


def _aged(stage: str, start: str, end: str) -> str:
    bins = lambda x: f"CASE WHEN {x} < 2 THEN 0 WHEN {x} < 5 THEN 1 WHEN {x} < 9 THEN 2 ELSE 3 END"
    return f"""{stage}_n AS (SELECT side, greatest(CAST(ceil(({end} - {start}) / {float(DAY_NS)}) AS BIGINT), 1) AS n FROM st), {stage}_g AS (SELECT side, n, unnest(generate_series(0, n - 1)) AS s FROM {stage}_n),
{stage}_h AS (SELECT side, {bins("s")} AS bin, (count(*) FILTER (WHERE s = n - 1) + 0.5) / (count(*) + 1.0) AS h FROM {stage}_g GROUP BY ALL),
{stage}_s AS (SELECT a.side, age, coalesce(h, 0) AS h, coalesce(exp(sum(ln(1 - coalesce(h, 0))) OVER (PARTITION BY a.side ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS alive
    FROM (SELECT DISTINCT side, unnest(generate_series(0, (SELECT max(arrival_ns) // {DAY_NS} - min(arrival_ns) // {DAY_NS} + 60 FROM att))) AS age FROM att) a LEFT JOIN {stage}_h ON {stage}_h.side = a.side AND {stage}_h.bin = {bins("age")})"""


def _flowed(stage: str, inflow: str) -> str:
    """Stock and outflow of a stage on every day from inflow (side, k, n)."""
    return f"""{stage} AS (SELECT d.side, d.k, coalesce(sum(n * alive) FILTER (WHERE i.k < d.k), 0) AS stock, coalesce(sum(n * alive * h), 0) AS outflow
    FROM days d LEFT JOIN {inflow} i ON i.side = d.side AND i.k <= d.k LEFT JOIN {stage}_s s ON s.side = d.side AND s.age = d.k - i.k GROUP BY ALL)"""


_DAYS = f"days AS (SELECT DISTINCT side, unnest(generate_series((SELECT min(route_ns) // {DAY_NS} FROM st), (SELECT max(route_ns) // {DAY_NS} + 30 FROM st))) AS k FROM st), fed AS (SELECT side, route_ns // {DAY_NS} AS k, count(*) AS n FROM st GROUP BY ALL)"


def _hazards(t: Tables, start: str, end: str) -> DataFrame:
    return life.hazard_by_step(life.hazard(staged(t), ["side"], start, end, "expected_tokens", _EDGES, DAY_NS, 0.5), ["side"], _EDGES, _AGES)


def _days(t: Tables) -> tuple[DataFrame, DataFrame]:
    """What is routed on each day, and each side's days."""
    fed = staged(t).groupBy("side", window_index("route_ns", DAY_NS).alias("k")).agg(F.count("*").alias("n"))
    ends = fed.agg(F.min("k").alias("lo"), (F.max("k") + 30).alias("hi")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)).cast(f"array<{fed.schema['side'].dataType.simpleString()}>")))
    return fed, ends.join(fed.select("side").distinct(), "side")


@query(f"""{_STAGES}, {_DAYS}, {_aged("handoff", "route_ns", "ready_ns")}, {_aged("waiting", "ready_ns", "admission_ns")}, {_flowed("handoff", "fed")}, passed AS (SELECT side, k, outflow AS n FROM handoff), {_flowed("waiting", "passed")}
SELECT side, k, 'handoff' AS stage, round(stock, 5) AS stock, round(outflow, 5) AS outflow FROM handoff UNION ALL SELECT side, k, 'waiting', round(stock, 5), round(outflow, 5) FROM waiting""")
def cohort_cascade(t: Tables) -> DataFrame:
    """Two stages by their hazards, day by day: what leaves the first enters the second."""
    fed, days = _days(t)
    found = life.cascade(fed, {"handoff": _hazards(t, "route_ns", "ready_ns"), "waiting": _hazards(t, "ready_ns", "admission_ns")}, ["side"], days)
    return found.select("side", "k", "stage", F.round("stock", 5).alias("stock"), F.round("outflow", 5).alias("outflow"))


_WAIT_FED = f"wfed AS (SELECT side, ready_ns // {DAY_NS} AS k, count(*) AS n, sum(expected_tokens) AS tokens FROM st GROUP BY ALL), wdays AS (SELECT side, unnest(generate_series(min(k), max(k) + 30)) AS k FROM wfed GROUP BY side)"


@query(f"""{_STAGES}, {_WAIT_FED}, {_aged("waiting", "ready_ns", "admission_ns")}
SELECT d.side, d.k, CASE WHEN d.k - i.k < 2 THEN 0 WHEN d.k - i.k < 5 THEN 1 WHEN d.k - i.k < 9 THEN 2 ELSE 3 END AS bin, round(sum(n * alive), 5) AS requests, round(sum(tokens * alive), 3) AS tokens
FROM wdays d JOIN wfed i ON i.side = d.side AND i.k < d.k JOIN waiting_s s ON s.side = d.side AND s.age = d.k - i.k GROUP BY ALL HAVING round(sum(n * alive), 5) >= 0.001""")
def age_hist_predicted(t: Tables) -> DataFrame:
    """What waits on each day by the age that the hazards let it have, in requests and in tokens; bins of a thousandth of a request or more."""
    fed = staged(t).groupBy("side", window_index("ready_ns", DAY_NS).alias("k")).agg(F.count("*").alias("n"), F.sum("expected_tokens").alias("tokens"))
    days, steps = fed.groupBy("side").agg(F.min("k").alias("lo"), (F.max("k") + 30).alias("hi")), _hazards(t, "ready_ns", "admission_ns")
    requests = life.predicted_ages(fed, steps, ["side"], days, _EDGES).withColumnRenamed("n", "requests")
    tokens = life.predicted_ages(fed, steps, ["side"], days, _EDGES, mass="tokens").withColumnRenamed("n", "tokens")
    both = requests.join(tokens, ["side", "k", "bin"]).select("side", "k", "bin", F.round("requests", 5).alias("requests"), F.round("tokens", 3).alias("tokens"))
    return both.where("requests >= 0.001")


def _kernel_sql(name: str, start: str, end: str) -> str:
    """Constant and weight of log1p of a delay by the standardised logarithm of the tokens expected."""
    return f"""{name}_x AS (SELECT ln(1 + expected_tokens) AS f, ln(1 + ({end} - {start}) / 1e9) AS y FROM st), {name}_m AS (SELECT avg(f) AS m, stddev_pop(f) AS s FROM {name}_x),
{name}_k AS (SELECT avg(y) AS c, sum((f - m) / s * y) / (count(*) + 10) AS w, any_value(m) AS m, any_value(s) AS s FROM {name}_x, {name}_m)"""


@query(f"""{_STAGES}, {_kernel_sql("hk", "route_ns", "ready_ns")}, {_kernel_sql("wk", "ready_ns", "admission_ns")},
pd AS (SELECT st.*, greatest(CAST(trunc((exp(hk_k.c + hk_k.w * (ln(1 + expected_tokens) - hk_k.m) / hk_k.s) - 1) * 1e9) AS BIGINT), 0) AS hp, greatest(CAST(trunc((exp(wk_k.c + wk_k.w * (ln(1 + expected_tokens) - wk_k.m) / wk_k.s) - 1) * 1e9) AS BIGINT), 0) AS wp FROM st, hk_k, wk_k),
ww AS ({" UNION ALL ".join(f"SELECT '{w}' AS world, side, route_ns, route_ns + {'hp' if h else 'ready_ns - route_ns'} AS a, route_ns + {'hp' if h else 'ready_ns - route_ns'} + {'wp' if q else 'admission_ns - ready_ns'} AS b, terminal_ns FROM pd" for w, (h, q) in attribution.WORLDS.items())}),
iv AS (SELECT world, side, 'handoff' AS stage, route_ns AS x, a AS y FROM ww UNION ALL SELECT world, side, 'waiting', a, b FROM ww UNION ALL SELECT world, side, 'running', b, greatest(terminal_ns, b) FROM ww),
ik AS (SELECT world, side, stage, (x + {WEEK - 1}) // {WEEK} AS lo, (y + {WEEK - 1}) // {WEEK} AS hi FROM iv), c AS (SELECT world, side, stage, unnest(generate_series(lo, hi - 1)) AS k FROM ik WHERE lo < hi),
g AS (SELECT side, stage, k, {", ".join(f"count(*) FILTER (WHERE world = '{w}') AS w_{w}" for w in attribution.WORLDS)} FROM c GROUP BY ALL),
e AS ({" UNION ALL ".join(f"SELECT '{w}' AS world, stage, w_observed AS a, w_{w} AS p FROM g" for w in attribution.WORLDS)})
SELECT world, stage, count(*) AS n, round(sqrt(sum((a - p) * (a - p)) / greatest(sum(a * a), 1e-30)), 6) AS nrmse, round(avg(p - a), 6) AS bias, round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 9) AS exact FROM e GROUP BY ALL""")
def event_attribution(t: Tables) -> DataFrame:
    """Weekly inventories of three stages by observed and by predicted delays: the error of each stage's kernel alone and of both."""
    rows, f = staged(t), F.log1p(F.col("expected_tokens").cast("double"))
    seconds = lambda a, b: (F.col(b) - F.col(a)) / 1e9
    kernel = lambda a, b: (dynamics.delay(rows, seconds(a, b), [f], 10.0).column([f]) * 1e9).cast("long")
    predicted = rows.select("side", "route_ns", "ready_ns", "admission_ns", "terminal_ns", kernel("route_ns", "ready_ns").alias("handoff_ns"), kernel("ready_ns", "admission_ns").alias("waiting_ns"))
    found = attribution.errors(attribution.worlds(predicted), ["side"], WEEK, 1 << 40)
    return found.select("world", "stage", "n", F.round("nrmse", 6).alias("nrmse"), F.round("bias", 6).alias("bias"), F.round("exact", 9).alias("exact"))


_SPLIT = "CASE run % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"
_GRID = [(rank, penalty) for rank in (1, 2) for penalty in (0.01, 1.0, 100.0)]
_TOLERANCE = 0.005


def _candidate(rank: int, penalty: float, learned: str, errors: str) -> str:
    """A query of a candidate's errors: fitted on the rows with a split among ``learned``."""
    features = [f"x{i}" for i in range(rank)] + ["one"]
    fit = normal_equations(f"(SELECT * FROM fr WHERE split IN ({learned}))", features, ["y"], penalty, 1)
    of = " + ".join(f"b{i}_0 * {f}" for i, f in enumerate(features))
    error = lambda s: f"sqrt(sum(pow(y - ({of}), 2)) FILTER (WHERE split = '{s}') / sum(y * y) FILTER (WHERE split = '{s}')) AS {s}"
    return f"(WITH {fit} SELECT {rank} AS rank, CAST({penalty} AS DOUBLE) AS penalty, {', '.join(map(error, errors.split()))} FROM fr, th)"


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, CAST(count(*) AS DOUBLE) AS n, sum(input_tokens) / 1000.0 AS m FROM att GROUP BY ALL),
fr AS (SELECT * FROM (SELECT {_SPLIT} AS split, n AS x0, CAST(m AS DOUBLE) AS x1, lead(n) OVER (PARTITION BY run ORDER BY k) AS y, 1 AS one FROM wk) z WHERE y IS NOT NULL),
ca AS ({" UNION ALL ".join(_candidate(r, p, "'train'", "train validation") for r, p in _GRID)}), te AS ({" UNION ALL ".join(_candidate(r, p, "'train', 'validation'", "test") for r, p in _GRID)}),
ch AS (SELECT rank, penalty FROM ca WHERE validation <= (SELECT min(validation) FROM ca) + {_TOLERANCE} ORDER BY rank, validation, penalty DESC LIMIT 1),
me AS (SELECT sqrt(sum(pow(y - m, 2)) / sum(y * y)) AS e FROM fr, (SELECT avg(y) AS m FROM fr WHERE split <> 'test') WHERE split = 'test')
SELECT ca.rank, ca.penalty, round(train, 6) AS train, round(validation, 6) AS validation, ch.rank IS NOT NULL AS chosen, CASE WHEN ch.rank IS NOT NULL THEN round(test, 6) END AS test, CASE WHEN ch.rank IS NOT NULL THEN round(1 - test / e, 6) END AS skill
FROM ca JOIN te ON ca.rank = te.rank AND ca.penalty = te.penalty LEFT JOIN ch ON ca.rank = ch.rank AND ca.penalty = ch.penalty, me""")
def frozen_scan(t: Tables) -> DataFrame:
    """Models of the next week's arrivals: candidates of a scan, the one that is frozen, and its error on the test, read after that."""
    y = F.lead("n").over(W.partitionBy("run").orderBy("k"))
    rows = weekly(t).select(F.expr(_SPLIT).alias("split"), F.array(F.col("n").cast("double"), F.col("tokens") / 1000).alias("x"), F.array(y.cast("double")).alias("y"), y.isNotNull().alias("_is")).where("_is").drop("_is")
    p = protocol.Protocol(t.spark, scratch(t.spark, "scan"), rows)
    protocol.scanned(p, "x", "y", sorted({c for _, c in _GRID}), sorted({r for r, _ in _GRID}), _TOLERANCE)
    best = protocol.tested(p, "x", "y")
    same = lambda c: (c["rank"], c["penalty"]) == (best["rank"], best["penalty"])
    found = [(c["rank"], c["penalty"], c["train"], c["validation"], same(c), best["test"] if same(c) else None, best["skill"] if same(c) else None) for c in p.candidates()]
    names = ("train", "validation", "test", "skill")
    return t.spark.createDataFrame(found, "rank int, penalty double, train double, validation double, chosen boolean, test double, skill double").withColumns({c: F.round(c, 6) for c in names})


@query(f"""wk AS (SELECT run, arrival_ns // {WEEK} AS k, count(*) AS n, sum(input_tokens) AS m FROM att GROUP BY ALL), ou AS (SELECT run, terminal_ns // {WEEK} AS k, count(*) AS done, sum(expected_tokens) AS out FROM life WHERE terminal_event = 'request_complete' AND terminal_ns IS NOT NULL GROUP BY ALL),
jo AS (SELECT wk.run, row_number() OVER (PARTITION BY wk.run ORDER BY wk.k) - 1 AS i, n, m / 1000.0 AS m, coalesce(done, 0) AS done, coalesce(out, 0) / 1000.0 AS out FROM wk LEFT JOIN ou ON ou.run = wk.run AND ou.k = wk.k),
bl AS (SELECT run, i // 25 AS block, CAST(sum(n) AS DOUBLE) / 25 AS n, CAST(sum(m) AS DOUBLE) / 25 AS m, 1 AS one, CAST(sum(done) AS DOUBLE) AS done, CAST(sum(out) AS DOUBLE) AS out FROM jo GROUP BY run, i // 25 HAVING count(*) = 25),
{normal_equations("bl", ["n", "m", "one"], ["done", "out"], 1.0, 1)}
SELECT run, block, done, round(b0_0 * n + b1_0 * m + b2_0, 3) AS done_predicted, round(out, 3) AS out, round(b0_1 * n + b1_1 * m + b2_1, 3) AS out_predicted FROM bl, th""")
def slow_head(t: Tables) -> DataFrame:
    """Outputs of twenty-five windows from the means of what arrived in them."""
    ended = t.life.where("terminal_event = 'request_complete' and terminal_ns is not null")
    outputs = ended.groupBy("run", window_index("terminal_ns", WEEK).alias("k")).agg(F.count("*").alias("done"), (F.sum("expected_tokens") / 1000.0).alias("out"))
    rows = weekly(t).select("run", "k", "n", (F.col("tokens") / 1000.0).alias("m")).join(outputs, ["run", "k"], "left").fillna(0)
    blocks = protocol.slow_rows(rows, ["run"], "k", 25, ["n", "m"], ["done", "out"])
    head = dynamics.fitted(blocks, {"x": F.col("x")}, F.col("y"), 1.0)
    p = head.column({"x": F.col("x")})
    return blocks.select("run", "block", F.col("y")[0].alias("done"), F.round(p[0], 3).alias("done_predicted"), F.round(F.col("y")[1], 3).alias("out"), F.round(p[1], 3).alias("out_predicted"))
