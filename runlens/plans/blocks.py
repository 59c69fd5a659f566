"""Ordered scans over groups of any size.

A plain ``Window.partitionBy(run)`` sends a whole run to one task, which fails
when a single run holds a third of the data.  Here every group is cut into
blocks of bounded size.  Windows run inside a block; what a block needs from
its neighbours (last known value, next known value, running total) comes from
one small row per block that is scanned per group and joined back.  A small
group is simply a group with one block, so there is a single code path.

* ``block_of`` cuts a group by its dense row number.
* ``number_rows`` makes dense row numbers for data that has none: the rows are laid out in
  ranges of (key, order), whatever their number, and stored once, so that all later
  branches of a plan agree on the ranges.
* ``Scan`` evaluates the ordered expressions.
* ``attach`` joins one row per group to all rows of the group, by block.

A group whose key is NULL is a group like any other: while rows are joined by their keys, a NULL
key is replaced by a stand-in and a flag (``sealed``), and put back afterwards.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

BLOCK_ROWS = 2_000_000
# Exponent that the weights of a running sum reach in a block.
REACH = 100.0
BLOCK = "_block"


def block_of(seq: Column | str, block_rows: int = BLOCK_ROWS) -> Column:
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(block_rows)).cast("long")


_STAND_INS = {"string": "", "binary": "", "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _flag(key: str) -> str:
    return f"_null_{key}"


def sealed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with keys that are never NULL, and the columns that now name a group: the keys and their flags."""
    kinds = {f.name: f for f in df.schema}
    open_keys = [k for k in keys if kinds[k].nullable and _flag(k) not in kinds]
    made = {}
    for k in open_keys:
        kind = kinds[k].dataType.simpleString()
        made[k] = F.coalesce(F.col(k), F.lit(_STAND_INS.get(kind, 0)).cast(kind))
        made[_flag(k)] = F.col(k).isNull()
    return df.withColumns(made) if made else df, [*keys, *[_flag(k) for k in keys if k in open_keys or _flag(k) in kinds]]


def opened(df: DataFrame, keys: list[str]) -> DataFrame:
    """Undoes ``sealed``."""
    flags = {k: _flag(k) for k in keys if _flag(k) in df.columns}
    return df.withColumns({k: F.when(~F.col(f), F.col(k)) for k, f in flags.items()}).drop(*flags.values()) if flags else df


def _met(here: tuple[DataFrame, list[str]], there: tuple[DataFrame, list[str]], keys: list[str], more: list[str], how: str) -> DataFrame:
    flags = {*here[1], *there[1]} - {*keys}
    left, right = (side.withColumns({f: F.lit(False) for f in flags if f not in names}) for side, names in (here, there))
    return opened(left.join(right, [*keys, *sorted(flags), *more], how), keys)


def meet(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which NULL is one like any other."""
    return _met(sealed(left, keys), sealed(right, keys), keys, [], how)


class Scan:
    """Ordered expressions over ``keys`` groups, evaluated block by block.

    ``order`` is a list of columns that orders the rows of a group totally and
    in which the block never decreases.  A table that has a block column keeps
    it (and with it its partitioning; ``keep_block`` leaves the keys sealed, for a following scan); else the block is
    cut from the order column.  A value is a column, or a dict of plain columns that yields a
    struct; ``when`` tells the rows that have the value (default: not null).
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], block: Column | None = None,
                 block_rows: int = BLOCK_ROWS, keep_block: bool = False):
        if block is None and BLOCK not in df.columns:
            block = block_of(order[0], block_rows)
        self.df, self.groups = sealed(df if block is None else df.withColumn(BLOCK, block), keys)
        self.keys = keys
        self.order = order
        self.keep_block = keep_block
        self._asked: list[tuple[str, str, Column | dict[str, Column], Column | None]] = []

    def _ask(self, kind: str, name: str, value, when: Column | None = None) -> "Scan":
        if when is None and isinstance(value, Column):
            when = value.isNotNull()
        self._asked.append((kind, name, value, F.lit(True) if when is None else when))
        return self

    def last(self, name: str, value, when: Column | None = None) -> "Scan":
        """Latest value up to and including the row."""
        return self._ask("last", name, value, when)

    def previous(self, name: str, value, when: Column | None = None) -> "Scan":
        """Latest value strictly before the row."""
        return self._ask("previous", name, value, when)

    def next(self, name: str, value, when: Column | None = None) -> "Scan":
        """Earliest value from the row on."""
        return self._ask("next", name, value, when)

    def total(self, name: str, value: Column) -> "Scan":
        """Running sum up to and including the row."""
        return self._ask("total", name, value)

    def rest(self, name: str, value: Column) -> "Scan":
        """Sum from the row to the end of its group."""
        return self._ask("rest", name, value)

    def least_before(self, name: str, value: Column) -> "Scan":
        """Smallest value strictly before the row."""
        return self._ask("least", name, value)

    def greatest_before(self, name: str, value: Column) -> "Scan":
        """Largest value strictly before the row."""
        return self._ask("greatest", name, value)

    def result(self) -> DataFrame:
        where = [*self.groups, BLOCK]
        inside = W.partitionBy(*where)
        # A frame that reaches to the end of its partition is re-read for every
        # row; the same frame over the reversed order is a single pass.
        forward = inside.orderBy(*self.order).rowsBetween(W.unboundedPreceding, 0)
        before = inside.orderBy(*self.order).rowsBetween(W.unboundedPreceding, -1)
        onward = inside.orderBy(*[F.col(o).desc() for o in self.order]).rowsBetween(W.unboundedPreceding, 0)
        frame = {"last": forward, "previous": before, "next": onward, "total": forward, "rest": onward, "least": before, "greatest": before}
        earlier = W.partitionBy(*self.groups).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
        later = W.partitionBy(*self.groups).orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
        beyond = {"last": earlier, "previous": earlier, "next": later, "total": earlier, "rest": later, "least": earlier, "greatest": earlier}
        ends = {"least": (F.min, F.least), "greatest": (F.max, F.greatest)}

        # Edges of a block as plain numbers, so that they aggregate by hash.
        at = F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)
        edges, carries, locals_, out = [], [], [], []
        for kind, name, value, when in self._asked:
            here, there = F.col(f"_local_{name}"), F.col(f"_carry_{name}")
            if kind in ("total", "rest"):
                edges.append(F.sum(value).alias(f"_e_{name}"))
                carries.append(F.sum(f"_e_{name}").over(beyond[kind]).alias(f"_carry_{name}"))
                locals_.append(F.sum(value).over(frame[kind]).alias(f"_local_{name}"))
                out.append(F.when(there.isNull(), here).when(here.isNull(), there).otherwise(here + there).alias(name))
                continue
            if kind in ends:
                best, of_both = ends[kind]
                edges.append(best(value).alias(f"_e_{name}"))
                carries.append(best(f"_e_{name}").over(beyond[kind]).alias(f"_carry_{name}"))
                locals_.append(best(value).over(frame[kind]).alias(f"_local_{name}"))
                out.append(of_both(here, there).alias(name))
                continue
            fields = value if isinstance(value, dict) else {"v": value}
            pick = F.min_by if kind == "next" else F.max_by
            edges += [pick(c, F.when(when, at)).alias(f"_e_{name}_{f}") for f, c in fields.items()]
            edges.append(F.count_if(when).alias(f"_n_{name}"))
            held = F.struct(*[F.col(f"_e_{name}_{f}").alias(f) for f in fields])
            row = F.struct(*[c.alias(f) for f, c in fields.items()])
            if not isinstance(value, dict):
                held, row = F.col(f"_e_{name}_v"), value
            carries.append(F.last(F.when(F.col(f"_n_{name}") > 0, held), ignorenulls=True).over(beyond[kind]).alias(f"_carry_{name}"))
            locals_.append(F.last(F.when(when, row), ignorenulls=True).over(frame[kind]).alias(f"_local_{name}"))
            out.append(F.coalesce(here, there).alias(name))

        carried = self.df.groupBy(*where).agg(*edges).select(*where, *carries)
        joined = self.df.select("*", *locals_).join(carried, where)
        kept = [c for c in self.df.columns if c != BLOCK or self.keep_block]
        done = joined.select(*kept, *out)
        return done if self.keep_block else opened(done, self.keys)


def lay_out(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in key-and-order ranges, stored, with their range number.

    Range partitioning splits a hot key because the order columns are part of
    the range key; adaptive execution settles the number of ranges by their size.  The
    stored table pins the range numbers.
    """
    laid = df.repartitionByRange(*keys, *order).withColumn(BLOCK, F.spark_partition_id().cast("long"))
    return written(laid, "ranges")


def ordered_scan(df: DataFrame, keys: list[str], order: list[str]) -> Scan:
    """A Scan over data without row numbers."""
    return Scan(lay_out(df, keys, order), keys, order, F.col(BLOCK))


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Dense row numbers from 0 inside each group."""
    counted = ordered_scan(df, keys, order).total(name, F.lit(1).cast("long")).result()
    return counted.withColumn(name, F.col(name) - 1)


def rolling(df: DataFrame, keys: list[str], pos: str, name: str, make, width: int,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``make()`` over the last ``width`` rows; ``pos`` is a dense row number in the group.

    The last ``width - 1`` rows of a block are copied to the next one.
    """
    block_rows = max(block_rows, width)
    home = block_of(pos, block_rows)
    tail = F.col(pos) % block_rows >= block_rows - (width - 1)
    copied = (df.withColumn("_home", home)
              .withColumn(BLOCK, F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))))
    frame = W.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(-(width - 1), 0)
    return (copied.withColumn(name, make().over(frame))
            .where(F.col(BLOCK) == F.col("_home")).drop(BLOCK, "_home"))


def attach(df: DataFrame, per_group: DataFrame, keys: list[str], how: str = "inner", seq: str = "seq",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join one row per group to the group's rows without gathering a hot group.

    ``per_group`` carries ``last_seq`` (see ``last_seq``), from which its row is
    repeated once per block; the join key is then (keys, block).
    """
    spread = (per_group.withColumn(BLOCK, F.explode(F.sequence(F.lit(0).cast("long"), block_of("last_seq", block_rows))))
              .drop("last_seq"))
    here = sealed(df.withColumn(BLOCK, block_of(seq, block_rows)), keys)
    return _met(here, sealed(spread, keys), keys, [BLOCK], how).drop(BLOCK)


def last_seq(seq: str = "seq") -> Column:
    return F.max(seq).alias("last_seq")


def affine_scan(df: DataFrame, keys: list[str], pos: str, value: str, decay: float, start: str, name: str,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """y[i] = decay*y[i-1] + value[i], y[-1] = start (constant per group), pos dense from 0.

    Inside a block the recurrence is a weighted running sum; the block length is
    chosen so that the weights decay**-i stay finite.  The block ends follow the same
    recurrence with decay**length, and are summed the same way, level by level, until a
    whole block fades to zero in double precision.  Nothing is cut off before.
    """
    if decay >= 1.0:
        raise ValueError("decay must be below 1; use a running total instead")
    held, groups = sealed(df, keys)
    return opened(_affine(held, groups, pos, value, decay, start, name, block_rows), keys)


def _affine(df: DataFrame, keys: list[str], pos: str, value: str, decay: float, start: str, name: str, block_rows: int) -> DataFrame:
    if decay <= 1e-300:  # of an earlier row nothing is left
        return df.withColumn(name, F.col(value))
    rate = -log(decay)
    length = int(max(2, min(block_rows, REACH / rate)))
    at = F.col(pos) % length
    inside = W.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * F.pow(F.lit(decay), -at)).over(inside)
    rows = df.withColumn("_blk", block_of(pos, length)).withColumn("_local", scaled * F.pow(F.lit(decay), at))
    ends = rows.groupBy(*keys, "_blk").agg(F.max_by("_local", pos).alias("_end"), F.min(start).alias("_y0"))
    summed = _affine(ends.withColumnsRenamed({"_blk": "_pos0"}), keys, "_pos0", "_end", decay ** length, "_y0", "_sum", block_rows)
    handed = F.struct((F.col("_pos0") + 1).alias("_blk"), F.col("_sum").alias("_in"))
    initial = F.struct(F.lit(0).cast("long").alias("_blk"), F.col("_y0").alias("_in"))
    into = summed.select(*keys, F.inline(F.when(F.col("_pos0") == 0, F.array(initial, handed)).otherwise(F.array(handed))))
    return (rows.join(into, [*keys, "_blk"])
            .withColumn(name, F.col("_local") + F.col("_in") * F.pow(F.lit(decay), at + 1))
            .drop("_blk", "_local", "_in"))
