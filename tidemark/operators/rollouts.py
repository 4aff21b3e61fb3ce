"""Free rollouts of fitted models: what they predict from a run's first state on, fed with nothing but its inputs.

A step is an affine map of the state, s' = s A + (inputs) B + c, in which A may itself depend on the row's gains
(controls, loads). Maps compose, so a run is a scan of maps: rows are dealt to blocks, each block's maps are composed
into one matrix and one offset, the states at the blocks' starts follow from those alone, and every block is then
walked by itself. Lags, memories and previous rows are parts of an augmented state. A run ends where a state is beyond
the bound: the least such row over all its blocks, from where on predictions are null.

Flows that are clipped to what there is aren't affine: they are walked along the run in Arrow batches of bounded size,
with the stocks handed on from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.dynamics import Flow, Model
from tidemark.operators.linear import importable
from tidemark.operators.stats import nrmse

#: Rows of a block; a state beyond the bound ends a run.
BLOCK, BOUND = 1024, 1e6


@dataclass
class Walk:
    """s' = s @ (base + sum of gains) + inputs @ their weights + constant; the first ``outputs`` components are what is predicted.

    gains: (width, size, size) by name, inputs: (width, size) by name.
    """

    base: np.ndarray
    constant: np.ndarray
    outputs: int
    inputs: dict[str, np.ndarray] = field(default_factory=dict)
    gains: dict[str, np.ndarray] = field(default_factory=dict)

    def offsets(self, x: dict[str, np.ndarray], rows: int) -> np.ndarray:
        return self.constant + sum((x[k] @ w for k, w in self.inputs.items()), np.zeros((rows, len(self.constant))))

    def matrix(self, x: dict[str, np.ndarray], row: int) -> np.ndarray:
        return self.base + sum((np.tensordot(x[k][row], w, 1) for k, w in self.gains.items()), np.zeros_like(self.base))

    def composed(self, x: dict[str, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The map of all rows, one after another."""
        total, at, c = np.eye(len(self.base)), np.zeros(len(self.base)), self.offsets(x, rows)
        for k in range(rows):
            m = self.matrix(x, k) if self.gains else self.base
            total, at = total @ m if self.gains else total, at @ m + c[k]
        return total if self.gains else np.linalg.matrix_power(self.base, rows), at

    def states(self, start: np.ndarray, x: dict[str, np.ndarray], rows: int) -> np.ndarray:
        """The state before each row's step."""
        out, c = np.empty((rows, len(start))), self.offsets(x, rows)
        for k in range(rows):
            out[k] = start
            start = start @ (self.matrix(x, k) if self.gains else self.base) + c[k]
        return out


def lagged(model: Model) -> Walk:
    """Of dynamics.dynamics(): the state is z and z of the row before; inputs d, d_before, u; with zu, u is a gain too."""
    n = len(model.constant)
    base = np.zeros((2 * n, 2 * n))
    base[:n, :n], base[n:, :n], base[:n, n:] = model.parts["z"] + model.parts["dz"], -model.parts["dz"], np.eye(n)
    gains = {}
    if "zu" in model.parts:
        gains["gain"] = np.zeros((1, 2 * n, 2 * n))
        gains["gain"][0, :n, :n] = model.parts["zu"]
    return Walk(base, _wide(model.constant, 2 * n), n, {k: _wide(v, 2 * n) for k, v in model.parts.items() if k not in ("z", "dz", "zu")}, gains)


def remembering(model: Model, kind: str, signal: list[int], scales: list[int], dt: float = 0.2) -> Walk:
    """Of a model with block ``memory`` as dynamics.memory_radius() has it; what the signal has besides the state comes as input ``memory``, 0 at the state's places."""
    n, k = len(model.constant), len(signal)
    weights = model.parts["memory"]
    wide = len(weights) // (len(scales) if kind == "exponential" else scales[0] if kind == "raw_lag" else 3 * len(scales))
    part = lambda i: weights[i * wide : i * wide + k]
    pick = np.eye(n)[:, signal]
    if kind == "exponential":
        size = 2 * n + len(scales) * k
        base = np.zeros((size, size))
        for i, scale in enumerate(scales):
            at, a = slice(2 * n + i * k, 2 * n + (i + 1) * k), np.exp(-1.0 / scale)
            base[at, :n], base[at, at], base[:n, at] = part(i), a * np.eye(k), (1 - a) * pick
    else:
        depth = max(2, max(scales) + 1)
        size = depth * n
        base = np.zeros((size, size))
        base[: size - n, n:] = np.eye(size - n)
        for i in range(1, scales[0] + 1) if kind == "raw_lag" else ():
            base[i * n : (i + 1) * n, :n] += pick @ part(i - 1)
        for i, s in enumerate(scales) if kind != "raw_lag" else ():
            for j in range(s):
                base[j * n : (j + 1) * n, :n] += pick @ (part(3 * i) / s + part(3 * i + 1) * dt)
            base[:n, :n] += pick @ part(3 * i + 2)
            base[s * n : (s + 1) * n, :n] -= pick @ part(3 * i + 2)
    base[:n, :n] += model.parts["z"] + model.parts["dz"]
    base[n : 2 * n, :n] -= model.parts["dz"]
    base[:n, n : 2 * n] = np.eye(n)
    return Walk(base, _wide(model.constant, size), n, {b: _wide(v, size) for b, v in model.parts.items() if b not in ("z", "dz")})


def incremental(model: Model) -> Walk:
    """Of dynamics.increments(), fitted on the change of q: the state is q and q of the row before; everything else is input."""
    n = len(model.constant)
    base = np.zeros((2 * n, 2 * n))
    base[:n, :n], base[n:, :n], base[:n, n:] = np.eye(n) + model.parts["q"] + model.parts["dq"], -model.parts["dq"], np.eye(n)
    return Walk(base, _wide(model.constant, 2 * n), n, {k: _wide(v, 2 * n) for k, v in model.parts.items() if k not in ("q", "dq")})


def conserving(model: Model) -> Walk:
    """Of dynamics.conservation(), fitted on the change of q: inputs forcing and forcing_before, and loads as gains at level 2."""
    n = len(model.constant)
    loads = sorted((k for k in model.parts if k[0] == "q" and k[1:].isdigit()), key=lambda k: int(k[1:]))
    gains = {"loads": np.stack([model.parts[k] for k in loads])} if loads else {}
    base = np.eye(n) + model.parts.get("q", np.zeros((n, n)))
    return Walk(base, np.asarray(model.constant, float), n, {k: v for k, v in model.parts.items() if k.startswith("forcing")}, gains)


def _wide(x: np.ndarray, size: int) -> np.ndarray:
    """Weights of the first outputs as weights of a whole augmented state."""
    out = np.zeros((*np.shape(x)[:-1], size))
    out[..., : np.shape(x)[-1]] = x
    return out


def _arrays(t: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {k: t[k].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(float) for k in names}


def free(df: DataFrame, run: str, order: str, walk: Walk, columns: dict[str, Column], start: Column, bound: float = BOUND, block: int = BLOCK) -> DataFrame:
    """(run, order, predicted: array<double>) of each row: the state that the model has there, null from a state beyond the bound on.

    columns: the walk's inputs and gains as array columns; start: the augmented state, taken at each run's first row.
    """
    spark = df.sparkSession
    importable(spark)
    names = list(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(run, order, *(c.cast("array<double>").alias(k) for k, c in columns.items()), start.cast("array<double>").alias("_start"))
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy(run).orderBy(order)) - 1).withColumn("_b", F.floor(F.col("_i") / block))
    size = len(walk.constant)

    def compose(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        total, at = walk.composed(_arrays(t, names), t.num_rows)
        first = t["_start"].slice(0, 1) if t["_i"][0].as_py() == 0 else pa.nulls(1, pa.list_(pa.float64()))
        return pa.table({run: t[run].slice(0, 1), "_b": t["_b"].slice(0, 1), "_m": pa.array([total.ravel().tolist()], pa.list_(pa.float64())), "_o": pa.array([at.tolist()], pa.list_(pa.float64())), "_start": first})

    def starts(t: pa.Table) -> pa.Table:
        t = t.sort_by("_b")
        at = np.array(t["_start"][0].as_py(), float)
        out = []
        for k in range(t.num_rows):
            out.append(at.tolist())
            with np.errstate(all="ignore"):
                at = at @ np.array(t["_m"][k].as_py(), float).reshape(size, size) + np.array(t["_o"][k].as_py(), float)
        return pa.table({run: t[run], "_b": t["_b"], "_s": pa.array(out, pa.list_(pa.float64()))})

    def follow(t: pa.Table, at: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        with np.errstate(all="ignore"):
            found = walk.states(np.array(at["_s"][0].as_py(), float), _arrays(t, names), t.num_rows)[:, : walk.outputs]
            bad = ~(np.isfinite(found).all(axis=1) & (np.abs(found).max(axis=1, initial=0) <= bound))
        return pa.table({run: t[run], order: t[order], "_i": t["_i"], "_x": pa.array(found.tolist(), pa.list_(pa.float64())), "_bad": pa.array(bad)})

    maps = rows.groupBy(run, "_b").applyInArrow(compose, f"{run} {kinds[run]}, _b long, _m array<double>, _o array<double>, _start array<double>")
    begun = maps.groupBy(run).applyInArrow(starts, f"{run} {kinds[run]}, _b long, _s array<double>")  # a row for each block of a run
    walked = rows.groupBy(run, "_b").cogroup(begun.groupBy(run, "_b")).applyInArrow(follow, f"{run} {kinds[run]}, {order} {kinds[order]}, _i int, _x array<double>, _bad boolean")
    stop = F.min(F.when(F.col("_bad"), F.col("_i"))).over(W.partitionBy(run).orderBy("_i").rowsBetween(W.unboundedPreceding, 0))
    return walked.select(run, order, F.when(stop.isNull(), F.col("_x")).alias("predicted"))


def evaluated(rows: DataFrame, keys: list[str], actual: str, predicted: str, held: str) -> DataFrame:
    """(keys, output, n, ended, nrmse, persistence, skill) of each component of arrays; held: what stands still, e.g. the first state.

    ended: rows without a prediction; the others make the errors. Skill is what the model saves of the error of persistence.
    """
    places = F.sequence(F.lit(0), F.size(actual) - 1)
    each = F.explode(F.transform(places, lambda i: F.struct(i.alias("output"), F.get(F.col(actual), i).alias("a"), F.get(F.col(predicted), i).alias("p"), F.get(F.col(held), i).alias("h"))))
    long = rows.select(*keys, each.alias("x")).select(*keys, "x.*")
    known = F.col("p").isNotNull()
    a, p, h = (F.when(known, F.col(c)) for c in ("a", "p", "h"))
    g = long.groupBy(*keys, "output").agg(F.count_if(known).alias("n"), F.count_if(~known).alias("ended"), nrmse(a, p).alias("nrmse"), nrmse(a, h).alias("persistence"))
    return g.withColumn("skill", F.when(F.col("persistence") > 0, 1 - F.col("nrmse") / F.col("persistence")))


def flow_walk(stocks: np.ndarray, inflow: np.ndarray, flows: list[Flow]) -> tuple[np.ndarray, np.ndarray]:
    """Stocks (stages, sides, quantities) a window later, and the flows that left each stage; inflow (sides, quantities) enters the first."""
    out, after = np.zeros_like(stocks), stocks.copy()
    for i, model in enumerate(flows):
        both, all_in = stocks[i].sum(axis=0), inflow.sum(axis=0)
        x = np.concatenate([stocks[i], inflow, np.broadcast_to(both, stocks[i].shape), np.broadcast_to(all_in, inflow.shape)], axis=1) / model.inputs
        raw = model.model(x=x) * model.outputs
        out[i] = np.minimum(np.maximum(raw, 0), np.maximum(stocks[i] + inflow, 0))
        after[i] = stocks[i] + inflow - out[i]
        inflow = out[i]
    return after, out


def flow_rollout(df: DataFrame, run: str, order: str, inflow: str, start: str, flows: list[Flow], sides: int = 2) -> DataFrame:
    """(run, order, stocks, left: array<double>) along each run: what each stage has at a window's start, and what leaves it in the window.

    inflow: sides x quantities of each row; start: stages x sides x quantities, taken at a run's first row. Arrays are
    flat, stages first. Rows of a run are one after another in one task, in batches of bounded size.
    """
    importable(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stocks = None, np.zeros(0)
        for batch in batches:
            runs, have, left = batch.column(0).to_pylist(), [], []
            for k, key in enumerate(runs):
                feed = np.array(batch.column(2)[k].as_py(), float).reshape(sides, -1)
                if k == 0 and at is None or key != at[0]:
                    at, stocks = (key,), np.array(batch.column(3)[k].as_py(), float).reshape(len(flows), *feed.shape)
                have.append(stocks.ravel().tolist())
                stocks, out = flow_walk(stocks, feed, flows)
                left.append(out.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(have, pa.list_(pa.float64())), pa.array(left, pa.list_(pa.float64()))], names=[run, order, "stocks", "left"])

    rows = df.select(run, order, F.col(inflow).cast("array<double>"), F.col(start).cast("array<double>")).repartition(run).sortWithinPartitions(run, order)
    return rows.mapInArrow(walk, f"{run} {kinds[run]}, {order} {kinds[order]}, stocks array<double>, left array<double>")
