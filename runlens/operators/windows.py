"""Ordered operators: interpolation, smoothing, rates, filters, energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ieee_divide
from ..plans.blocks import (BLOCK, BLOCK_ROWS, Scan, affine_scan, block_of, rolling, sealed)

SERIES = ["run_id", "metric"]
COUNTERS = ["user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice"]
IDLE = ["idle", "iowait"]


def wide(samples: DataFrame, metrics: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per file line with a column per metric, in (run, block) partitions.

    The block column stays and the run is sealed, so that a following scan needs no other shuffle
    and both its branches use the same one.
    """
    cells = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    rows, run = sealed(samples.withColumn(BLOCK, block_of("seq", block_rows)).where(F.col(BLOCK).isNotNull()), ["run_id"])
    return (rows.repartition(*run, BLOCK).groupBy(*run, BLOCK, "seq").agg(F.min("t").alias("t"), *cells))


def long(table: DataFrame, metrics: list[str], keep: list[str] = ("run_id", "seq", "t")) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return table.select(*keep, F.inline(pairs))


def _line(t: Column, here: Column, before: Column, after: Column) -> Column:
    slope = F.try_divide((after["v"] - before["v"]) * (t - before["t"]), after["t"] - before["t"])
    return F.coalesce(here, before["v"] + slope)


def _with_neighbours(table: DataFrame, metrics: list[str], block_rows: int) -> DataFrame:
    scan = Scan(table, ["run_id"], ["seq"], block_rows=block_rows)
    for m in metrics:
        known = {"t": F.col("t"), "v": F.col(m)}
        scan.last(f"_before_{m}", known, F.col(m).isNotNull()).next(f"_after_{m}", known, F.col(m).isNotNull())
    return scan.result()


def interpolate_wide(table: DataFrame, metrics: list[str], clamped: bool = False,
                     block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill gaps of wide columns linearly in ``t``; with ``clamped`` the edges hold their value."""
    near = _with_neighbours(table, metrics, block_rows)
    filled = {}
    for m in metrics:
        before, after = F.col(f"_before_{m}"), F.col(f"_after_{m}")
        value = _line(F.col("t"), F.col(m), before, after)
        filled[m] = F.coalesce(value, before["v"], after["v"]) if clamped else value
    return near.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in table.columns if c != BLOCK and c in near.columns])


def interpolate(samples: DataFrame, metrics: list[str], clamped: bool = False,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Linear interpolation of each metric on every row of its run; outer gaps stay NULL."""
    table = wide(samples, metrics, block_rows)
    return long(interpolate_wide(table, metrics, clamped, block_rows), metrics)


def interp_clamped(samples: DataFrame, metrics: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    return interpolate(samples, metrics, True, block_rows)


def ffill_bfill(samples: DataFrame, metrics: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Last known value, or the first later one where there is none yet."""
    table = wide(samples, metrics, block_rows)
    scan = Scan(table, ["run_id"], ["seq"], block_rows=block_rows)
    for m in metrics:
        scan.last(f"_before_{m}", F.col(m)).next(f"_after_{m}", F.col(m))
    filled = scan.result().select("run_id", "seq", "t", *[
        F.coalesce(f"_before_{m}", f"_after_{m}").alias(m) for m in metrics])
    return long(filled, metrics)


def position(samples: DataFrame, name: str = "pos", block_rows: int = BLOCK_ROWS, keep_block: bool = False) -> DataFrame:
    """Dense row number of the known values of each (run, metric)."""
    counted = (Scan(samples.where(F.col("value").isNotNull()), SERIES, ["seq"], block_rows=block_rows, keep_block=keep_block)
               .total(name, F.lit(1).cast("long")).result())
    return counted.withColumn(name, F.col(name) - 1)


def smooth(samples: DataFrame, width: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean of the last ``width`` known values, fewer at the start; adds the series label."""
    placed = position(samples, "pos", block_rows)
    mean = rolling(placed, SERIES, "pos", "smoothed", lambda: F.avg("value"), width, block_rows)
    return mean.drop("pos").withColumn("label", F.concat(F.col("metric"), F.lit(f"-smooth{width}")))


def decimate(samples: DataFrame, n: int = 1, block_rows: int = BLOCK_ROWS, keep_block: bool = False) -> DataFrame:
    """Every n-th known value of each series; 0 keeps the first and the last."""
    known = samples.where(F.col("value").isNotNull())
    if n == 1:
        return known
    if n == 0:
        cells = [c for c in known.columns if c not in SERIES]
        ends = known.groupBy(*SERIES).agg(*[F.min_by(c, "seq").alias(f"_a_{c}") for c in cells], *[F.max_by(c, "seq").alias(f"_b_{c}") for c in cells])
        first, final = (F.struct(*[F.col(f"_{e}_{c}").alias(c) for c in cells]) for e in "ab")
        both = F.when(F.col("_a_seq") == F.col("_b_seq"), F.array(first)).otherwise(F.array(first, final))
        return ends.select(*SERIES, F.inline(both)).select(*known.columns)
    return position(known, "_pos", block_rows, keep_block).where(F.col("_pos") % n == 0).drop("_pos")


def ops_per_sec(samples: DataFrame, regex: str = "work_done", decimate_by: int = 1, drop_inf: bool = False,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Work per second between consecutive known values of each matching series."""
    work = decimate(samples.where(F.col("metric").rlike(regex)), decimate_by, block_rows, keep_block=True)
    before = Scan(work, SERIES, ["seq"], block_rows=block_rows).previous("_p", {"t": F.col("t"), "value": F.col("value")}).result()
    speed = ieee_divide(F.col("value") - F.col("_p.value"), F.col("t") - F.col("_p.t"))
    out = before.where(F.col("_p").isNotNull()).select(*SERIES, "seq", "t", speed.alias("ops"))
    if drop_inf:
        out = out.where(F.abs("ops") != float("inf"))
    return out


def cpu_load(counters: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Percent of non-idle ticks between two rows of 32-bit counters per (run, cpu)."""
    before = (Scan(counters, ["run_id", "cpu"], ["seq"], block_rows=block_rows)
              .previous("_p", {c: F.col(c) for c in COUNTERS}).result().where(F.col("_p").isNotNull()))

    def ticks(names):
        now = sum((F.col(n) for n in names), F.lit(0).cast("long"))
        then = sum((F.col(f"_p.{n}") for n in names), F.lit(0).cast("long"))
        return F.pmod(now - then, F.lit(4294967296)).cast("double")

    idle, active = ticks(IDLE), ticks([n for n in COUNTERS if n not in IDLE])
    load = F.coalesce(F.try_divide(active, active + idle) * 100, F.lit(0.0))
    return before.select("run_id", "cpu", "seq", "t", F.format_string("CPU%d_load/%%", F.col("cpu")).alias("metric"),
                         load.alias("load"))


def low_pass(samples: DataFrame, period: float, tau: float, y0: float | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First-order filter y = (1-a)*y + a*u with a = period/(tau + period), starting at y0 or the first value."""
    alpha = period / (tau + period)
    placed = position(samples, "_pos", block_rows)
    # The first row takes the start value along, so that every series starts at zero.
    first = F.col("value") if y0 is None else (1 - alpha) * F.lit(float(y0)) + alpha * F.col("value")
    placed = placed.withColumn("_u", F.when(F.col("_pos") == 0, first).otherwise(F.col("value") * alpha))
    return affine_scan(placed.withColumn("_start", F.lit(0.0)), SERIES, "_pos", "_u", 1.0 - alpha, "_start", "filtered",
                       block_rows).drop("_pos", "_u", "_start")


def energy(samples: DataFrame, scale: float = 1e-6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Energy step and running total: power of the row times the gap before it."""
    known = samples.where(F.col("value").isNotNull())
    gap = Scan(known, SERIES, ["seq"], block_rows=block_rows, keep_block=True).previous("_pt", F.col("t")).result()
    step = gap.withColumn("step", F.coalesce(F.col("value") * scale * (F.col("t") - F.col("_pt")), F.lit(0.0))).drop("_pt")
    return Scan(step, SERIES, ["seq"], block_rows=block_rows).total("energy", F.col("step")).result()


def throttle(samples: DataFrame, period: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows later than the mark plus ``period``; the mark starts at the first row and moves on by one period per row.

    After a gap rows come closer, until the mark has caught up.  A row before an earlier one's time is passed over.

    The number of marks moved is c = min(c of the row before + 1, a), where a counts the periods that
    lie wholly before the row.  So c minus the row's number is a running minimum of a minus the
    number, which blocks hand on as one value; a row comes out if it does not lower it.
    """
    known = samples.where(F.col("value").isNotNull() & F.col("t").isNotNull())
    scan = lambda df, keep=True: Scan(df, SERIES, ["seq"], block_rows=block_rows, keep_block=keep)
    rising = scan(known).greatest_before("_late", F.col("t")).result().where("_late IS NULL OR t >= _late").drop("_late")
    timed = scan(rising).total("_pos", F.lit(1).cast("long")).least_before("_t0", F.col("t")).result()
    timed = timed.withColumns({"_t0": F.coalesce("_t0", "t"), "_pos": F.col("_pos") - 1})
    step = F.lit(float(period))
    whole = F.ceil((F.col("t") - F.col("_t0")) / step).cast("long") - 1
    # The quotient is rounded: the greatest whole number of periods that lies before the row is a step away at most.
    after = lambda n: F.col("t") > F.col("_t0") + n * step
    whole = F.when(after(whole + 1), whole + 1).when(after(whole), whole).otherwise(whole - 1)
    ahead = F.greatest(whole, F.lit(0).cast("long")) - F.col("_pos")
    lowest = scan(timed.withColumn("_ahead", ahead), False).least_before("_low", F.col("_ahead")).result()
    return lowest.where(F.col("_ahead") >= F.col("_low")).drop("_pos", "_t0", "_ahead", "_low")


def time_to_threshold(samples: DataFrame, threshold: float, timeout: float, poll: float | None = None) -> DataFrame:
    """When each series first drops to the threshold, or that it timed out.

    ``poll`` looks only at rows on a polling grid of that many seconds.
    """
    seen = samples.where(F.col("value").isNotNull())
    if poll is not None:
        slot = F.ceil(F.col("t") / F.lit(float(poll))).cast("long")
        seen = (seen.groupBy(*SERIES, slot.alias("slot")).agg(F.max_by("value", "seq").alias("value"))
                .withColumn("t", F.col("slot") * F.lit(float(poll))))
    hit = F.min(F.when((F.col("value") <= threshold) & (F.col("t") <= timeout), F.col("t")))
    return (seen.groupBy(*SERIES).agg(hit.alias("reached_at"))
            .withColumn("status", F.when(F.col("reached_at").isNull(), F.lit("timed out")).otherwise(F.lit("done"))))
