"""Operators that carry a small state per series from one micro-batch to the next.

A micro-batch is a batch job: its rows are numbered by time in ranges and run through the same block scans as stored samples, so
a series of any length in one micro-batch is spread over tasks and no task holds a series.  What the next batch needs of a series is one
small row.  States and results are stored under the number of their batch: a batch that is run
again starts from the state before it and replaces its own results.

Rows at the last time of a series still count, whichever batch brings them; rows before it are late.  The
number of a series' late rows of a batch is in ``late`` on its last row that the batch brings out, on a row without time if there is no such row.  A series whose last row lies further back than ``forget`` behind the newest
row of all loses its state and starts anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.windows import COUNTERS, IDLE
from ..plans.blocks import Scan, affine_scan, meet, number_rows
from ..plans.scratch import delete, temporary, written

SEQ = "_seq"


@dataclass
class Carried:
    """A stream and what is done with each of its micro-batches.

    ``step`` takes rows numbered by ``_seq`` in each series, with the series' state in columns ``_was_<name>`` (NULL where it has none).  It
    returns all of them with the columns of ``out``, ``_emit`` for those that come out, and the state after each row as ``_now_<name>``.
    """

    stream: DataFrame
    keys: list[str]
    out: str
    state: str
    step: Callable[[DataFrame], DataFrame]
    known: str
    forget: float | None = None

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.state.split(", ")]

    def schema(self) -> str:
        types = {f.name: f.dataType.simpleString() for f in self.stream.schema}
        return ", ".join([*[f"`{k}` {types[k]}" for k in self.keys], self.out, "late long"])

    def forgetting(self, seconds: float) -> "Carried":
        return replace(self, forget=seconds)

    def advance(self, batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(results, states of all series) after a micro-batch."""
        rows = batch.where(self.known)
        if before is None:
            kinds = dict(c.split() for c in self.state.split(", "))
            rows = rows.withColumns({f"_was_{n}": F.lit(None).cast(kinds[n]) for n in self.names})
        else:
            rows = meet(rows, before.withColumnsRenamed({n: f"_was_{n}" for n in self.names}), self.keys, "left")
        late = F.coalesce(F.col("t") < F.col("_was_t"), F.lit(False))
        fresh = rows.where(~late).withColumn("_row", F.monotonically_increasing_id())
        numbered = number_rows(fresh, self.keys, ["t", "_row"], SEQ).drop("_row")
        names = [c.split()[0] for c in self.out.split(", ")]
        state = [f"_now_{n}" for n in self.names if n != "t"]
        done = written(self.step(numbered).select(*self.keys, SEQ, *names, "_emit", *state), "stepped")
        result = done.where("_emit")
        after = done.groupBy(*self.keys).agg(F.max("t").alias("t"), *[F.max_by(c, SEQ).alias(c.removeprefix("_now_")) for c in state])
        told = result.select(*self.keys, *names, F.lit(0).cast("long").alias("late"))
        if before is not None:
            counted = written(rows.where(late).groupBy(*self.keys).agg(F.count("*").alias("late")), "late")
            if counted.limit(1).count():
                ends = meet(counted, result.groupBy(*self.keys).agg(F.max(SEQ).alias(SEQ)), self.keys, "left")
                marked = meet(result, ends.where(F.col(SEQ).isNotNull()), [*self.keys, SEQ], "left")
                none = {f.name: F.lit(None).cast(f.dataType) for f in result.select(*names).schema}
                told = (marked.select(*self.keys, *names, F.coalesce("late", F.lit(0).cast("long")).alias("late"))
                        .unionByName(ends.where(F.col(SEQ).isNull()).drop(SEQ).withColumns(none)))
        if before is not None:
            old = before.withColumnsRenamed({n: f"_old_{n}" for n in self.names})
            both = meet(old, after.withColumn("_new", F.lit(True)), self.keys, "full")
            after = both.select(*self.keys, *[F.when(F.col("_new"), F.col(n)).otherwise(F.col(f"_old_{n}")).alias(n) for n in self.names])
        return told, after

    def write(self, path: str, checkpoint: str, **trigger):
        """Start the stream; results go to ``path/batch=N``, states beside the checkpoint.  Returns the query."""
        spark, states = self.stream.sparkSession, f"{checkpoint}/carried"

        def take(batch: DataFrame, number: int) -> None:
            with temporary(spark):
                before = spark.read.parquet(f"{states}/batch={number - 1}") if number else None
                told, after = self.advance(batch, before)
                told.write.mode("overwrite").parquet(f"{path}/batch={number}")
                if self.forget is not None:
                    newest = after.agg(F.max("t").alias("t")).select("t").scalar()
                    after = after.where(F.col("t") >= newest - self.forget)
                after.write.mode("overwrite").parquet(f"{states}/batch={number}")
            if number > 1:  # a batch that is run again needs the one before it only
                delete(spark, [f"{states}/batch={number - 2}"])

        return self.stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def low_pass_stream(samples: DataFrame, period: float, tau: float, y0: float | None = None, keys=("run_id", "metric")) -> Carried:
    """First-order filter that continues across batches."""
    alpha, keys = period / (tau + period), list(keys)

    def step(rows: DataFrame) -> DataFrame:
        start = F.coalesce("_was_y", F.col("value") if y0 is None else F.lit(float(y0)))
        part = F.col("value") * alpha
        rows = rows.withColumn("_u", F.when(F.col(SEQ) == 0, (1 - alpha) * start + part).otherwise(part)).withColumn("_zero", F.lit(0.0))
        out = affine_scan(rows, keys, SEQ, "_u", 1.0 - alpha, "_zero", "filtered")
        return out.withColumns({"_emit": F.lit(True), "_now_y": F.col("filtered")})

    return Carried(samples, keys, "t double, filtered double", "t double, y double", step, "t IS NOT NULL AND value IS NOT NULL")


def energy_stream(samples: DataFrame, scale: float = 1e-6, keys=("run_id", "metric")) -> Carried:
    """Energy total that continues across batches."""
    keys = list(keys)

    def step(rows: DataFrame) -> DataFrame:
        timed = Scan(rows, keys, [SEQ], keep_block=True).previous("_pt", F.col("t")).result()
        part = F.col("value") * scale * (F.col("t") - F.coalesce("_pt", "_was_t", "t"))
        summed = Scan(timed.withColumn("_step", part), keys, [SEQ]).total("_sum", F.col("_step")).result()
        total = F.col("_sum") + F.coalesce("_was_total", F.lit(0.0))
        return summed.withColumns({"energy": total, "_emit": F.lit(True), "_now_total": total})

    return Carried(samples, keys, "t double, energy double", "t double, total double", step, "t IS NOT NULL AND value IS NOT NULL")


def cpu_load_stream(counters: DataFrame, keys=("run_id", "cpu")) -> Carried:
    """CPU load from counter differences; the first row of a CPU only sets the state."""
    keys = list(keys)
    sums = {"active": [c for c in COUNTERS if c not in IDLE], "idle_": IDLE}

    def step(rows: DataFrame) -> DataFrame:
        now = rows.withColumns({n: sum((F.col(c).cast("long") for c in cells), F.lit(0).cast("long")) for n, cells in sums.items()})
        before = Scan(now, keys, [SEQ]).previous("_p", {n: F.col(n) for n in sums}).result()
        ticks = {n: F.pmod(F.col(n) - F.coalesce(F.col(f"_p.{n}"), F.col(f"_was_{n}")), F.lit(2**32)) for n in sums}
        total = ticks["active"] + ticks["idle_"]
        load = F.when(total > 0, ticks["active"] / total * 100).when(total.isNotNull(), 0.0)
        return before.withColumns({"load": load, "_emit": load.isNotNull(), **{f"_now_{n}": F.col(n) for n in sums}})

    return Carried(counters, keys, "t double, load double", "t double, active long, idle_ long", step, "t IS NOT NULL")


def throttled(samples: DataFrame, period: float, catch_up: bool = True, keys=("run_id", "metric")) -> Carried | DataFrame:
    """Emit a row when it is more than ``period`` after the last mark.

    With ``catch_up`` the mark moves on by one period per emitted row, so a gap
    is followed by closer rows (``operators.windows.throttle`` tells how that is spread over blocks); else it moves to the emitted row, which then
    needs to be at least a period after it: that form walks a series' rows of a micro-batch in one task.
    """
    keys = list(keys)
    if not catch_up:
        return _reset_to_now(samples, period, keys)

    def step(rows: DataFrame) -> DataFrame:
        timed = Scan(rows, keys, [SEQ], keep_block=True).least_before("_first", F.col("t")).result()
        origin, width = F.coalesce("_was_origin", "_first", "t"), F.lit(float(period))
        timed = timed.withColumn("_origin", origin)
        whole = F.ceil((F.col("t") - F.col("_origin")) / width).cast("long") - 1
        after = lambda n: F.col("t") > F.col("_origin") + n * width
        whole = F.when(after(whole + 1), whole + 1).when(after(whole), whole).otherwise(whole - 1)
        moved = F.coalesce("_was_moved", F.lit(0).cast("long"))
        ahead = F.greatest(whole - moved, F.lit(0).cast("long")) - F.col(SEQ)
        one = F.lit(1).cast("long")
        scanned = Scan(timed.withColumn("_ahead", ahead), keys, [SEQ]).least_before("_low", F.col("_ahead")).result()
        scanned = scanned.withColumn("_low", F.least("_low", one))
        return scanned.withColumns({"_emit": F.col("_ahead") >= F.col("_low"), "_now_origin": F.col("_origin"),
                                    "_now_moved": F.col(SEQ) + F.least("_low", "_ahead") + moved})

    return Carried(samples, keys, "t double, value double", "t double, origin double, moved long", step, "t IS NOT NULL AND value IS NOT NULL")


def _reset_to_now(samples: DataFrame, period: float, keys: list[str]) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "t double, value double, late long"])

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values("t", kind="stable")
        last, mark = state.get if state.exists else (-np.inf, None)
        fresh = rows[rows["t"] >= last]
        late = len(rows) - len(fresh)
        t, picked, i = fresh["t"].to_numpy(float), [], 0
        if len(t):
            mark = t[0] if mark is None else mark
            while (i := max(i, int(np.searchsorted(t, mark + period, "left")))) < len(t):
                picked.append(i)
                mark = t[i]
                i += 1
            state.update((float(t[-1]), float(mark)))
        chosen = fresh.iloc[picked]
        out = {"t": [*chosen["t"].astype(float), *[None] * (late > 0)], "value": [*chosen["value"].astype(float), *[None] * (late > 0)], "late": [*[0] * len(chosen), *[late] * (late > 0)]}
        yield pd.DataFrame({**{k: [part] * len(out["t"]) for k, part in zip(keys, key)}, **out})

    return samples.groupBy(*keys).applyInPandasWithState(advance, schema, "t double, mark double", "append", GroupStateTimeout.NoTimeout)
