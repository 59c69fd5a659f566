"""Output lines of programs: ``key=value`` to events, events to sparse rows.  Works on batch and stream alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    column: str
    key: str | None
    sync: bool


def parse_specs(specs: list[str]) -> list[Spec]:
    """``key=`` takes that key, a bare name takes all other lines, ``@`` marks values sampled on ticks."""
    if not specs:
        raise ValueError("no columns specified")
    out = []
    for text in specs:
        sync, name = text.startswith("@"), text.removeprefix("@")
        keyed = name.endswith("=")
        out.append(Spec(name.removesuffix("="), name.removesuffix("=") if keyed else None, sync))
    if sum(s.key is None for s in out) > 1:
        raise ValueError("at most one column without '=' allowed")
    return out


def parse_lines(lines: DataFrame, specs: list[str], stdout: str | None = None, trim: bool = True) -> DataFrame:
    """Each line to (metric, text, sync, catch_all); lines that no column takes are dropped.

    ``stdout`` names a column for whole unmatched lines where no spec is a catch-all.
    """
    known = parse_specs(specs)
    rest = next((s for s in known if s.key is None), None)
    if rest is None and stdout is not None:
        rest = Spec(stdout, None, False)
    line = F.regexp_replace("line", "[\r\n]+$", "") if trim else F.col("line")
    parts = F.split(line, "=", 2)
    table = {s.key: s for s in known if s.key is not None}
    matched = (F.size(parts) == 2) & parts[0].isin(list(table)) if table else F.lit(False)
    column, sync = None, None
    for key, s in table.items():
        column = (F if column is None else column).when(parts[0] == key, F.lit(s.column))
        sync = (F if sync is None else sync).when(parts[0] == key, F.lit(s.sync))
    other, other_sync = F.lit(rest.column if rest else None), F.lit(bool(rest and rest.sync))
    metric = F.when(matched, column).otherwise(other) if table else other
    kept = [c for c in lines.columns if c != "line"]
    return lines.select(*kept, metric.alias("metric"), F.when(matched, parts[1]).otherwise(line).alias("text"),
                        (F.when(matched, sync).otherwise(other_sync) if table else other_sync).alias("sync"),
                        (~matched).alias("catch_all")).where(F.col("metric").isNotNull())


# One step of the packing: a filled key starts a new row, a whole line closes its row.
_STEP = """
(a, x) -> if(x.flush,
  struct(array_append(if(coalesce(a.cur[x.metric], '') <> '', array_append(a.rows, a.cur), a.rows),
           map_concat(map_filter(if(coalesce(a.cur[x.metric], '') <> '', cast(map() as map<string,string>), a.cur), (k, v) -> k <> x.metric),
                      map(x.metric, x.text))) as rows,
         cast(map() as map<string,string>) as cur),
  struct(if(coalesce(a.cur[x.metric], '') <> '', array_append(a.rows, a.cur), a.rows) as rows,
         map_concat(map_filter(if(coalesce(a.cur[x.metric], '') <> '', cast(map() as map<string,string>), a.cur), (k, v) -> k <> x.metric),
                    map(x.metric, x.text)) as cur))"""


def pack_rows(events: DataFrame, batch: list[str], flush_unmatched: bool = True) -> DataFrame:
    """Values of one read batch share a row until a key repeats: (batch…, row_no, cells).

    A batch is what one read of a pipe returned, at most its buffer (64 KiB),
    so collecting it is bounded.  An empty value does not start a new row.
    """
    flush = F.col("catch_all") if flush_unmatched else F.lit(False)
    listed = F.array_sort(F.collect_list(F.struct("seq", "metric", "text", flush.alias("flush")))).alias("_e")
    rows = F.expr(f"""aggregate(_e,
        struct(cast(array() as array<map<string,string>>) as rows, cast(map() as map<string,string>) as cur), {_STEP},
        a -> if(size(a.cur) > 0, array_append(a.rows, a.cur), a.rows))""")
    return events.groupBy(*batch).agg(listed).select(*batch, F.posexplode(rows).alias("row_no", "cells"))
