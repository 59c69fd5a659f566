"""Box-bounded fits of T(t) = T_inf + sum k*exp(-t/tau) for every series at once.

For given time constants the model is linear, so only the taus are searched: on a grid, and from its best
point by Gauss-Newton steps (``functions/exponentials.py``).
One pass over the samples reduces each series to moments in time bins whose
width grows with t; every exponential sum follows from the moments to about
double precision.  A series has a few hundred bins at most, however long it
is, so all later steps work on a small table that is partitioned by series once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxed import solve_boxed
from ..functions.exponentials import STEPS, Bins, grid_best, normal_equations, refined
from ..functions.model import component_expr, jacobian, model_expr
from ..functions.numbers import clamp, t_critical
from ..functions.text import common_prefix, fit_text
from ..plans.blocks import BLOCK_ROWS, attach, last_seq, meet, opened, sealed
from ..plans.grids import K_BOUNDS, T_BOUNDS, TAU_BOUNDS, expand_bounds, tau_tuples
from ..plans.scratch import written
from .windows import SERIES

BINS_PER_FOLD = 64
MOMENTS = 6
# Rows of moments that a task takes at least, and that it handles at once.
TASK_ROWS, CHUNK_ROWS = 200_000, 50_000


def _from_origin(samples: DataFrame, keys: list[str], t_origin: str, block_rows: int) -> DataFrame:
    known = samples.where(F.col("value").isNotNull() & F.col("t").isNotNull())
    if t_origin == "absolute":
        return known
    if t_origin != "first":
        raise ValueError(f"unknown t_origin {t_origin}")
    start = known.groupBy(*keys).agg(F.min_by("t", "seq").alias("_t0"), last_seq())
    return attach(known, start, keys, block_rows=block_rows).withColumn("t", F.col("t") - F.col("_t0")).drop("_t0")


def summarize(samples: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Time-bin moments per series; ``floor`` is the smallest time constant of interest.

    Bin edges are even in asinh(t/floor): fine near zero, a constant fraction of t later.
    """
    place = F.floor(F.asinh(F.col("t") / floor) * BINS_PER_FOLD).cast("int")
    centre = F.sinh((F.col("_bin") + 0.5) / BINS_PER_FOLD) * floor
    rows = samples.withColumn("_bin", place).withColumn("_d", F.col("t") - centre)
    powers = [F.lit(1.0)]
    for _ in range(1, MOMENTS):
        powers.append(powers[-1] * F.col("_d"))
    return (rows.groupBy(*keys, "_bin").agg(
        *[F.sum(p).alias(f"m{i}") for i, p in enumerate(powers)],
        *[F.sum(p * F.col("value")).alias(f"y{i}") for i, p in enumerate(powers)],
        F.sum(F.col("value") * F.col("value")).alias("yy"),
        F.min("seq").alias("seq_first"), F.min_by("t", "seq").alias("t_first"),
        F.max("seq").alias("seq_last"), F.max_by("t", "seq").alias("t_last"))
        .withColumn("centre", centre))


def _exp_sum(rate: str, moments: str) -> str:
    """SQL for sum of w*exp(-rate*t) over a bin from its moments of weight w (Taylor series at the bin centre)."""
    poly = ""
    for i in reversed(range(MOMENTS)):
        term = f"{moments}{i} * {1 / factorial(i)!r}D"
        poly = f"{term} - ({rate}) * ({poly})" if poly else term
    return f"exp(-({rate}) * centre) * ({poly})"


def _linear_sums(candidates: DataFrame, keys: list[str], order: int) -> DataFrame:
    """Normal-equation sums per (series, tau tuple)."""
    rate = [f"1D / x{i}" for i in range(order)]
    sums = {"a_0_0": "m0", "b_0": "y0", "yy": "yy"}
    for i in range(order):
        sums[f"a_0_{i + 1}"] = _exp_sum(rate[i], "m")
        sums[f"b_{i + 1}"] = _exp_sum(rate[i], "y")
        for j in range(i, order):
            sums[f"a_{i + 1}_{j + 1}"] = _exp_sum(f"{rate[i]} + {rate[j]}", "m")
    return (candidates.groupBy(*keys, *[f"x{i}" for i in range(order)])
            .agg(*[F.expr(f"sum({e})").alias(n) for n, e in sums.items()]))


def _tuples(values: list[tuple[float, ...]]) -> str:
    rows = ", ".join("struct(" + ", ".join(f"{float(v)!r}D as x{i}" for i, v in enumerate(tup)) + ")" for tup in values)
    return f"array({rows})"


def _best(sums: DataFrame, keys: list[str], order: int, boxes: list[tuple[float, float]], width: int) -> DataFrame:
    """Least residual sum per series over its tau tuples, coefficients inside their box.

    Each batch of aggregated rows is solved at once and keeps its best row per
    series; the rest of the choice is a small aggregate.
    """
    size = order + 1
    taus = [f"x{i}" for i in range(order)]
    coefs = [f"v{i}" for i in range(size)]

    def solved(batches):
        for pdf in batches:
            a = np.empty((len(pdf), size, size))
            for i in range(size):
                for j in range(i, size):
                    a[:, i, j] = a[:, j, i] = pdf[f"a_{i}_{j}"].to_numpy(float)
            b = pdf[[f"b_{i}" for i in range(size)]].to_numpy(float)
            v, rss = solve_boxed(a, b, pdf["yy"].to_numpy(float), boxes)
            out = pdf[[*keys, *taus]].assign(n=pdf["a_0_0"], rss=rss, **{c: v[:, i] for i, c in enumerate(coefs)})
            out = out[np.isfinite(rss)]
            out = out.assign(rank=out["rss"].round(9)).sort_values(["rank", *taus]).drop_duplicates(keys)
            yield out[[*keys, "n", "rss", *coefs, *taus]]

    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n double", "rss double", *[f"{c} double" for c in [*coefs, *taus]]])
    some = sums.mapInPandas(solved, schema)
    row = F.struct("n", "rss", *coefs, *taus)
    return some.repartition(width, *keys).groupBy(*keys).agg(F.min_by(row, F.struct(F.round("rss", 9), *taus)).alias("p")).select(*keys, "p.*")


def _width(df: DataFrame) -> int:
    """Tasks for a table of moments: few bytes but much work, so they must not be merged by size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))


def _search(summary: DataFrame, keys: list[str], order: int, tau_bounds, k_bounds, t_bounds, points, rounds, taus,
            seeds: DataFrame | None = None) -> DataFrame:
    """(keys, n, rss, v0 ..., x0 ...): the best grid point, refined by at most ``rounds`` steps; from ``seeds`` without a grid."""
    boxes = [tuple(map(float, t_bounds)), *expand_bounds(k_bounds, order)]
    seeded = seeds is not None
    tuples = [] if seeded else tau_tuples(order, tau_bounds, points, taus)
    width = _width(summary)
    if not rounds:
        tried = summary.repartition(width, *keys).select("*", F.inline(F.expr(_tuples(tuples))))
        return _best(_linear_sums(tried, keys, order), keys, order, boxes, width)
    rows, bounds = summary, None
    given = [f"{c}{i}" for i in range(order) for c in ("x", "lo", "hi")]
    if seeded:
        rows = summary.join(seeds.select(*keys, *given), keys)
    else:
        bounds = np.array(expand_bounds(tau_bounds, order))

    def solved(table: pa.Table) -> pa.RecordBatch:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            column = table.column(k).combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)))
        heads = np.flatnonzero(new)
        numbers = lambda c: table.column(c).to_numpy().astype(float)
        bins = Bins(heads, numbers("centre"), *(np.stack([numbers(f"{w}{i}") for i in range(MOMENTS)]) for w in "my"), numbers("yy"))
        if not seeded:
            low, high = (np.broadcast_to(bounds[:, i], (bins.n, order)) for i in (0, 1))
            start, v, rss = grid_best(bins, tuples, boxes)
        else:
            low, start, high = (np.stack([numbers(f"{c}{i}")[heads] for i in range(order)], axis=1) for c in ("lo", "x", "hi"))
            v, rss = solve_boxed(*normal_equations(bins, start), bins.yy, boxes)
        start, v, rss = refined(bins, start, v, rss, low, high, boxes, rounds)
        found = np.flatnonzero(np.isfinite(rss))
        out = {k: table.column(k).take(pa.array(heads[found])).combine_chunks() for k in keys}
        out |= {"n": pa.array(np.add.reduceat(numbers("m0"), heads)[found]), "rss": pa.array(rss[found])}
        out |= {f"v{i}": pa.array(v[found, i]) for i in range(order + 1)} | {f"x{i}": pa.array(start[found, i]) for i in range(order)}
        return pa.RecordBatch.from_pydict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.num_rows < CHUNK_ROWS:
                continue
            last = held.select(keys).slice(held.num_rows - 1).to_pylist()[0]
            end = held.num_rows  # the last series may go on in the next batch
            while end and held.select(keys).slice(end - 1, 1).to_pylist()[0] == last:
                end -= 1
            if end:
                yield solved(held.slice(0, end))
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield solved(held)

    types = {f.name: f.dataType.simpleString() for f in summary.schema}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "n double", "rss double", *[f"v{i} double" for i in range(order + 1)], *[f"x{i} double" for i in range(order)]])
    needed = [*keys, "centre", "yy", *[f"{w}{i}" for w in "my" for i in range(MOMENTS)], *(given if seeded else [])]
    return rows.select(*needed).repartition(width, *keys).sortWithinPartitions(*keys, "centre").mapInArrow(run, schema)


def _finish(best: DataFrame, ends: DataFrame, keys: list[str], order: int, compat_rmse: bool) -> DataFrame:
    terms = F.array(*[F.struct(F.col(f"v{i + 1}").alias("k"), F.col(f"x{i}").alias("tau")) for i in range(order)])
    by_tau = F.array_sort(terms, lambda a, b: F.when(a["tau"] < b["tau"], -1).when(a["tau"] > b["tau"], 1).otherwise(0))
    dof = F.col("points") - (2 * order + 1)
    enough = dof > 0
    rmse = F.sqrt(F.try_divide(F.col("rss"), dof)) * (2.0 if compat_rmse else 1.0)
    joined = ends.join(best.drop("n"), keys, "left")
    return joined.select(*keys, F.col("points").alias("n"), F.when(enough, F.col("rss")).alias("rss"),
                         F.when(enough, rmse).alias("rmse"), F.when(enough, F.col("v0")).alias("tinf"),
                         F.when(enough, by_tau).alias("terms"), "t_first", "t_last")


def _ends(summary: DataFrame, keys: list[str]) -> DataFrame:
    return (summary.repartition(*keys).groupBy(*keys)
            .agg(F.sum("m0").cast("long").alias("points"), F.min_by("t_first", "seq_first").alias("t_first"),
                 F.max_by("t_last", "seq_last").alias("t_last")))


def fit(samples: DataFrame, order: int = 2, tau_bounds=TAU_BOUNDS, k_bounds=K_BOUNDS, t_bounds=T_BOUNDS,
        t_origin: str = "absolute", points: int | None = None, rounds: int | None = None, taus: list[float] | None = None,
        compat_rmse: bool = False, keys: list[str] = SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fit every series: keys, n, rss, rmse, tinf, terms(k, tau) by rising tau, t_first, t_last.

    ``points`` sets the start grid, ``rounds`` the most Gauss-Newton steps from its best point; ``rounds=0`` with
    ``taus`` searches exactly the given values.  Series with no more rows than
    parameters keep NULL results.
    """
    rounds = STEPS if rounds is None else rounds
    floor = min(lo for lo, _ in expand_bounds(tau_bounds, order))
    held, groups = sealed(_from_origin(samples, keys, t_origin, block_rows), keys)
    summary = written(summarize(held, groups, floor), "moments")
    best = _search(summary, groups, order, tau_bounds, k_bounds, t_bounds, points, rounds, taus)
    return opened(_finish(best, _ends(summary, groups), groups, order, compat_rmse), keys)


def fit_quick(samples: DataFrame, order: int = 2, **options) -> DataFrame:
    """The fit with time counted from the first row of each series."""
    return fit(samples, order, t_origin="first", **options)


def fit_saturating(samples: DataFrame, **options) -> DataFrame:
    """y = a*(1 - b*exp(-c*x)) by the order-1 fit: a = T_inf, b = -k/T_inf, c = 1/tau."""
    wide = {"k_bounds": [(float("-inf"), float("inf"))], "t_bounds": (float("-inf"), float("inf")), **options}
    fits = fit(samples, 1, **wide)
    term = F.col("terms")[0]
    return fits.select("run_id", "metric", "n", "rmse", F.col("tinf").alias("a"),
                       F.try_divide(-term["k"], F.col("tinf")).alias("b"), (1 / term["tau"]).alias("c"))


def refit_around(samples: DataFrame, fits: DataFrame, order: int, frac: float = 0.05, k_bounds=K_BOUNDS,
                 t_bounds=T_BOUNDS, rounds: int = STEPS, compat_rmse: bool = False, t_origin: str = "absolute", keys: list[str] = SERIES,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fit again with every tau kept within ``frac`` of an earlier fit.

    The time bins are as fine as the smallest tau asks for.
    """
    held, groups = sealed(_from_origin(samples, keys, t_origin, block_rows), keys)
    seeds, flags = sealed(fits.where(F.col("terms").isNotNull()), keys)
    seeds = seeds.withColumns({f: F.lit(False) for f in groups if f not in flags})
    held, groups = held.withColumns({f: F.lit(False) for f in flags if f not in groups}), [*groups, *(f for f in flags if f not in groups)]
    for i in range(order):
        tau = F.col("terms")[i]["tau"]
        seeds = (seeds.withColumn(f"x{i}", tau).withColumn(f"lo{i}", tau * (1 - frac)).withColumn(f"hi{i}", tau * (1 + frac)))
    seeds = seeds.select(*groups, *[f"{n}{i}" for i in range(order) for n in ("x", "lo", "hi")])
    floor = seeds.agg(F.min(F.least(*[F.col(f"lo{i}") for i in range(order)]) if order > 1 else F.col("lo0"))).first()[0] or 1.0
    summary = written(summarize(held, groups, floor), "moments")
    best = _search(summary, groups, order, None, k_bounds, t_bounds, None, rounds, None, seeds)
    return opened(_finish(best, _ends(summary, groups), groups, order, compat_rmse), keys)


def fit_sweep(samples: DataFrame, horizons: list[float], order: int = 2, tau_bounds=TAU_BOUNDS, k_bounds=K_BOUNDS,
              t_bounds=T_BOUNDS, points: int | None = None, rounds: int = STEPS, taus: list[float] | None = None,
              compat_rmse: bool = False) -> DataFrame:
    """One fit per (series, horizon) over the rows before the horizon.

    The moments are taken per segment between horizons, once; a horizon adds up
    its segments, so no sample is copied per horizon.
    """
    edges = sorted(float(h) for h in horizons)
    known = samples.where(F.col("value").isNotNull() & (F.col("t") < edges[-1]))
    segment = F.size(F.filter(F.array(*[F.lit(h) for h in edges]), lambda h: F.col("t") >= h))
    floor = min(lo for lo, _ in expand_bounds(tau_bounds, order))
    held, groups = sealed(known.withColumn("_segment", segment), SERIES)
    summary = written(summarize(held, [*groups, "_segment"], floor), "moments")
    later = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(edges)])
    under = F.transform(F.filter(later, lambda x: x["i"] >= F.col("_segment")), lambda x: x["h"])
    summary = summary.select("*", F.explode(under).alias("horizon")).drop("_segment")
    keys = [*groups, "horizon"]
    best = _search(summary, keys, order, tau_bounds, k_bounds, t_bounds, points, rounds, taus)
    return opened(_finish(best, _ends(summary, keys), keys, order, compat_rmse), SERIES)


def certified(samples: DataFrame, fits: DataFrame, order: int = 2, tau_bounds=TAU_BOUNDS, k_bounds=K_BOUNDS, t_bounds=T_BOUNDS,
              tolerance: float = 1e-4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fits with ``optimal``: whether the conditions of an optimum in the box hold on the samples themselves.

    Every parameter lies in its box.  Seen from the residuals no column of the Jacobian points inwards: its cosine with them is
    ``tolerance`` at most, in either direction inside the box and in the direction into the box at a bound.  Terms sit in any of their boxes' order.
    """
    sums = normal_sums(samples, fits, order, block_rows)
    joined = meet(fits, sums.drop("n").withColumnRenamed("rss", "_rss"), SERIES, "left")
    terms = expand_bounds(tau_bounds, order), expand_bounds(k_bounds, order)
    same = len(set(terms[0])) == len(set(terms[1])) == 1
    checks = []

    def check(value: Column, at: int, box: tuple[float, float]) -> Column:
        cosine = F.try_divide(F.col(f"jr_{at}"), F.sqrt(F.col(f"jj_{at}_{at}") * F.col("_rss")))
        cosine = F.coalesce(cosine, F.lit(0.0))
        slack = 1e-9 * max(1.0, *(abs(e) for e in box if abs(e) != float("inf")), 1.0)
        low, high = value <= box[0] + slack, value >= box[1] - slack
        return (value >= box[0] - slack) & (value <= box[1] + slack) & ((cosine <= tolerance) | high) & ((cosine >= -tolerance) | low)

    checks.append(check(F.col("tinf"), 0, tuple(map(float, t_bounds))))
    for i in range(order):
        for kind, box in (("k", terms[1]), ("tau", terms[0])):
            # Terms come sorted by tau; where they have boxes of their own, any of these may be theirs.
            allowed = [box[0]] if same else sorted(set(box))
            term = F.col("terms")[i][kind]
            hit = check(term, 1 + 2 * i + (kind == "tau"), allowed[0])
            for other in allowed[1:]:
                hit = hit | check(term, 1 + 2 * i + (kind == "tau"), other)
            checks.append(hit)
    whole = checks[0]
    for c in checks[1:]:
        whole = whole & c
    return joined.select(*fits.columns, F.when(F.col("terms").isNotNull(), whole).alias("optimal"))


def initial_guess(samples: DataFrame, order: int = 2, tau_bounds=TAU_BOUNDS, k_bounds=K_BOUNDS, t_bounds=T_BOUNDS) -> DataFrame:
    """Start point of a local search: last value, even share of the drop, box midpoints."""
    known = samples.where(F.col("value").isNotNull())
    ends = known.groupBy(*SERIES).agg(F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last"))
    share = (F.col("first") - F.col("last")) / order
    cells = [clamp(F.col("last"), *t_bounds).alias("tinf")]
    for i, ((klo, khi), (tlo, thi)) in enumerate(zip(expand_bounds(k_bounds, order), expand_bounds(tau_bounds, order)), 1):
        cells += [clamp(share, klo, khi).alias(f"k{i}"), F.lit(tlo + (thi - tlo) / 2).alias(f"tau{i}")]
    return ends.select(*SERIES, *cells)


def with_fit(samples: DataFrame, fits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The known samples of every fitted series beside its parameters."""
    known = samples.where(F.col("value").isNotNull())
    params = fits.where(F.col("terms").isNotNull()).select(*SERIES, "tinf", "terms")
    sized = meet(known.groupBy(*SERIES).agg(last_seq()), params, SERIES)
    return attach(known, sized, SERIES, block_rows=block_rows)


def residuals(samples: DataFrame, fits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Samples with the model value and the residual."""
    model = model_expr(F.col("t"), F.col("tinf"), F.col("terms"))
    return (with_fit(samples, fits, block_rows).withColumn("model", model)
            .withColumn("residual", F.col("value") - F.col("model")).drop("tinf", "terms"))


def normal_sums(samples: DataFrame, fits: DataFrame, order: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sums of Jacobian products jj_i_j and jr_i with the residuals, per series."""
    rows = with_fit(samples, fits, block_rows)
    r = F.col("value") - model_expr(F.col("t"), F.col("tinf"), F.col("terms"))
    cells = jacobian(F.col("t"), F.col("terms"), order)
    size = len(cells)
    rows = rows.select(*SERIES, r.alias("_r"), *[c.alias(f"_j{i}") for i, c in enumerate(cells)])
    sums = [F.sum(F.col(f"_j{i}") * F.col(f"_j{j}")).alias(f"jj_{i}_{j}") for i in range(size) for j in range(i, size)]
    sums += [F.sum(F.col(f"_j{i}") * F.col("_r")).alias(f"jr_{i}") for i in range(size)]
    return rows.groupBy(*SERIES).agg(F.count("*").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("rss"), *sums)


def parameter_errors(samples: DataFrame, fits: DataFrame, order: int, err_kind: str = "assumed_sigma", sigma: float = 0.5,
                     alpha: float = 0.05, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fits with tinf_err and per-term k_err, tau_err.

    ``assumed_sigma`` takes every reading to be off by ``sigma``; ``student_t``
    gives the confidence margin from the residuals.
    """
    size = 2 * order + 1
    sums = normal_sums(samples, fits, order, block_rows)
    names = [f"jj_{i}_{j}" for i in range(size) for j in range(i, size)]

    def inverse_diagonals(batches):
        upper = np.triu_indices(size)
        for pdf in batches:
            flat = pdf[names].to_numpy(float)
            m = np.zeros((len(flat), size, size))
            m[:, upper[0], upper[1]] = flat
            m[:, upper[1], upper[0]] = flat
            unit = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-300))
            inv = np.linalg.pinv(m / unit[:, :, None] / unit[:, None, :], hermitian=True)
            out = pdf[[*SERIES, "n", "rss"]].copy()
            out["diag"] = list(np.maximum(np.einsum("nii->ni", inv), 0.0) / unit**2)
            yield out

    types = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in [*SERIES, "n", "rss"]) + ", diag array<double>"
    diag = sums.mapInPandas(inverse_diagonals, schema)
    dof = F.col("n") - size
    if err_kind == "assumed_sigma":
        factor = F.lit(sigma)
    elif err_kind == "student_t":
        factor = F.when(dof > 0, t_critical(dof, alpha) * F.sqrt(F.try_divide(F.col("rss"), dof)))
    else:
        raise ValueError(f"unknown err_kind {err_kind}")
    errs = diag.select(*SERIES, F.transform("diag", lambda d: F.sqrt(d) * factor).alias("_err"))
    joined = meet(fits, errs, SERIES, "left")
    terms = F.transform("terms", lambda x, i: F.struct(
        x["k"].alias("k"), x["tau"].alias("tau"),
        F.try_element_at(F.col("_err"), (2 * i + 2).cast("int")).alias("k_err"),
        F.try_element_at(F.col("_err"), (2 * i + 3).cast("int")).alias("tau_err")))
    return joined.withColumn("tinf_err", F.try_element_at("_err", F.lit(1))).withColumn("terms", terms).drop("_err")


def flat_terms(fits: DataFrame, order: int) -> DataFrame:
    """terms[i] as k1, tau1, k2, tau2, …"""
    cells = {}
    for i in range(order):
        cells[f"k{i + 1}"] = F.col("terms")[i]["k"]
        cells[f"tau{i + 1}"] = F.col("terms")[i]["tau"]
    return fits.withColumns(cells)


def multi_fit(samples: DataFrame, metrics: list[str], runs: DataFrame | None = None, order: int = 2,
              subtract: str | None = None, err_kind: str | None = None, work: str = "work_done",
              drop_inf: bool = False, name: str | None = None, block_rows: int = BLOCK_ROWS, **options) -> DataFrame:
    """Fit metrics of all runs: name, metric, n, rmse, ops, ops_err, tinf, k1, tau1, …, title.

    ``subtract`` names a metric whose interpolated value is taken off first;
    ``runs(run_id, name)`` gives the labels, else the run id is the name.
    """
    from .aggregates import ops_est
    from .joins import subtract as minus

    if subtract is None:
        series = samples.where(F.col("metric").isin(metrics))
    else:
        series = minus(samples, metrics, subtract, block_rows)
    fits = fit(series, order, block_rows=block_rows, **options)
    if err_kind:
        fits = parameter_errors(series, fits, order, err_kind, block_rows=block_rows)
    speed = ops_est(samples, work, drop_inf=drop_inf, block_rows=block_rows)
    out = meet(fits, speed, ["run_id"], "left")
    labels = (fits.select("run_id").distinct().withColumn("name", F.col("run_id").cast("string")) if runs is None
              else runs.select("run_id", "name"))
    out = flat_terms(meet(out, labels, ["run_id"], "left"), order)
    title = F.lit(name) if name is not None else labels.agg(common_prefix(F.col("name")).alias("p")).scalar()
    return out.withColumn("title", title).withColumn("subtract", F.lit(subtract is not None))


def legend(fits: DataFrame, minutes: bool = False, markup: str = "gnuplot") -> DataFrame:
    """Fits with their text form."""
    return fits.withColumn("text", fit_text(F.col("tinf"), F.col("terms"), minutes, markup))


def _grid(fits: DataFrame, tmin: Column, tmax: Column, n: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    return fits.where(F.col("terms").isNotNull()).select("*", at).withColumn("t", tmin + (tmax - tmin) * F.col("i") / F.lit(n - 1))


def fit_curves(fits: DataFrame, n: int = 500, per_series: bool = False) -> DataFrame:
    """Fitted model on n even points over the time range of all fits, or of each."""
    if per_series:
        grid = _grid(fits, F.col("t_first"), F.col("t_last"), n)
    else:
        span = fits.agg(F.min("t_first").alias("a"), F.max("t_last").alias("b"))
        grid = _grid(fits, span.select("a").scalar(), span.select("b").scalar(), n)
    return grid.select(*SERIES, "i", "t", model_expr(F.col("t"), F.col("tinf"), F.col("terms")).alias("value"))


def fit_components(fits: DataFrame, n: int = 500) -> DataFrame:
    """T_inf plus one exponential at a time on the grid of each series."""
    grid = _grid(fits, F.col("t_first"), F.col("t_last"), n)
    each = grid.select("*", F.posexplode("terms").alias("term_no", "term"))
    return each.select(*SERIES, "term_no", F.col("term.tau").alias("tau"), "i", "t",
                       component_expr(F.col("t"), F.col("tinf"), F.col("term")).alias("value"))
