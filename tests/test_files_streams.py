"""Files cut into blocks, sinks, and streams fed in several batches."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.operators import windows as batch
from runlens.plans.scratch import scratch_path
from runlens.sources import runfiles, tail
from runlens.streaming import sinks, stateful, windows


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path / name)


def test_files_with_different_headers(spark, tmp_path):
    a = write(tmp_path, "a.csv", '# Started at: 2020-05-01 10:00:00 +0200, Version: 1.2-3, Generated by: bench -x, y\ntime/ms,CPU_0_temp/m°C,stdout\n0,40000,\n1000,,"a ""x"", b"\n2000,42000,\n')
    b = write(tmp_path, "b.csv", '# no facts\ntime/ms,"comma,comma",CPU_0_temp/mC\n0,1,\n500,nan,50000\n')
    got = runfiles.read_runs(spark, [a, b])
    rows = {(r.run_id.split("/")[-1], r.seq, r.t, r.metric, r.unit, r.value, r.text) for r in got.samples.where("not isnan(value) or value is null").collect()}
    assert rows == {("a.csv", 0, 0.0, "CPU_0_temp", "°C", 40.0, None), ("a.csv", 1, 1.0, "stdout", "no unit", None, 'a "x", b'),
                    ("a.csv", 2, 2.0, "CPU_0_temp", "°C", 42.0, None), ("b.csv", 0, 0.0, "comma,comma", "no unit", 1.0, None),
                    ("b.csv", 1, 0.5, "CPU_0_temp", "°C", 50.0, None)}
    assert runfiles.nan_to_null(got.samples).count() == 5
    runs = {r.name: r for r in got.runs.collect()}
    assert (runs["a.csv"].version, runs["a.csv"].command, runs["a.csv"].zone) == ("1.2-3", "bench -x, y", "+0200")
    assert str(runs["a.csv"].started_at) == "2020-05-01 10:00:00" and runs["a.csv"].n_rows == 3
    assert runs["b.csv"].started_at is None and runs["b.csv"].version is None and runs["b.csv"].n_rows == 2
    assert "version" not in runs["b.csv"].meta and runs["a.csv"].meta["version"] == "1.2-3"
    names = {(r.run_id.split("/")[-1], r.pos, r.name) for r in got.columns.collect()}
    assert ("b.csv", 1, "comma,comma") in names and ("a.csv", 2, "stdout") in names


def test_parts_of_a_run_have_their_own_headers(spark, tmp_path):
    write(tmp_path / "run_id=7", "part-1.csv", "# Version: 3\ntime/ms,a,b\n0,1,2\n1000,3,4\n")
    write(tmp_path / "run_id=7", "part-2.csv", "# more\ntime/ms,b,c\n# a remark\n2000,5,6\n")
    write(tmp_path / "run_id=7", "part-3.csv", "3000,7,8\n")
    got = runfiles.read_runs(spark, str(tmp_path))
    rows = {(r.seq, r.t, r.metric, r.value) for r in got.samples.collect()}
    assert rows == {(0, 0.0, "a", 1.0), (0, 0.0, "b", 2.0), (1, 1.0, "a", 3.0), (1, 1.0, "b", 4.0), (2, 2.0, "b", 5.0), (2, 2.0, "c", 6.0), (3, 3.0, "b", 7.0), (3, 3.0, "c", 8.0)}
    assert [(r.run_id, r.n_rows, r.version) for r in got.runs.collect()] == [("7", 4, "3")]
    assert [r.name for r in got.columns.orderBy("pos").collect()] == ["time", "a", "b", "c"]


def test_stream_of_files_that_come_later(spark, tmp_path):
    write(tmp_path / "in", "a.csv", 'time/ms,v,note\n0,1,"x\ny"\n')
    stream, out, state = (scratch_path(spark, x) for x in ("s", "later", "later-state"))

    def run():
        rows = runfiles.read_runs_stream(spark, str(tmp_path / "in"))
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    run()
    write(tmp_path / "in", "b.csv", "time/ms,w\n# remark\n500,2\n600,3\n")
    run()
    got = {(r.file.split("/")[-1], r.seq, r.t, r.metric, r.text) for r in spark.read.parquet(out).collect()}
    assert got == {("a.csv", 0, 0.0, "v", "1"), ("a.csv", 0, 0.0, "note", "x\ny"), ("b.csv", 0, 0.5, "w", "2"), ("b.csv", 1, 0.6, "w", "3")}


def test_a_metric_without_column_fails_the_write(spark):
    samples = spark.createDataFrame([("r", 0, 0.0, "v", 1.0, None), ("r", 0, 0.0, "w", 2.0, None)], "run_id string, seq long, t double, metric string, value double, text string")
    columns = spark.createDataFrame([("r", 1, "v", "v")], "run_id string, pos int, raw_name string, metric string")
    runs = spark.createDataFrame([("r", "1")], "run_id string, version string").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("string").alias("zone"), F.lit("x").alias("command"))
    with pytest.raises(Exception, match="no column for metric w"):
        runfiles.run_lines(samples, columns, runs).collect()
    assert runfiles.run_lines(samples, columns, runs, drop_unlisted=True).where("seq = 0").first().value == "0.0,1.0"


def test_ties_over_a_batch_end_count(spark):
    schema, path = "run_id long, metric string, t double, value double", scratch_path(spark, "ties")
    for rows in ([(1, "p", 0.0, 1.0), (1, "p", 1.0, 1.0)], [(1, "p", 1.0, 3.0), (1, "p", 2.0, 1.0)], [(1, "p", 0.5, 9.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sinks.drain(stateful.low_pass_stream(stream, 10, 333, y0=0.0), "ties").collect()
    assert sorted(r.t for r in got if r.t is not None) == [0.0, 1.0, 1.0, 2.0] and sum(r.late for r in got) == 1


def test_file_cut_into_blocks_keeps_its_order(spark, tmp_path):
    n = 5000
    text = "# Version: 7\ntime/ms,v\n" + "".join(f"{i * 10},{i}\n" for i in range(n))
    path = write(tmp_path, "long.csv", text)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = runfiles.read_runs(spark, path)
        pdf = got.samples.orderBy("seq").toPandas()
        assert runfiles._lines(spark, path).select("start").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert list(pdf.seq) == list(range(n)) and list(pdf.value) == list(map(float, range(n)))


def test_a_long_run_is_written_in_parts(spark):
    rows = [("hot", i, i / 10, "v", float(i), None) for i in range(95)] + [("cold", i, i / 10, "w", float(i), None) for i in range(5)]
    samples = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double, text string")
    columns = spark.createDataFrame([("hot", 1, "v/°C", "v"), ("cold", 1, "w", "w")], "run_id string, pos int, raw_name string, metric string")
    runs = spark.createDataFrame([("hot", "1"), ("cold", None)], "run_id string, version string").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("string").alias("zone"), F.lit("x").alias("command"))
    path = scratch_path(spark, "parts")
    runfiles.write_runs(samples, columns, runs, path, block_rows=20)
    back = runfiles.read_runs(spark, path)
    assert spark.read.text(path).select("run_id", "part").distinct().where("run_id = 'hot'").count() == 5
    got = sorted((r.run_id, r.seq, round(r.t, 6), r.value) for r in back.samples.collect())
    assert got == sorted((r, s, t, v) for r, s, t, _, v, _ in rows)
    assert {r.run_id: (r.version, r.n_rows) for r in back.runs.collect()} == {"hot": ("1", 95), "cold": (None, 5)}


@pytest.fixture(scope="module")
def fed(spark):
    """Samples in four files that a stream takes one per batch, in time order, and the whole."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"run_id": rng.integers(0, 3, 400), "metric": "p", "t": np.sort(rng.uniform(0, 100, 400)), "value": rng.uniform(0, 9, 400)})
    pdf["seq"] = pdf.groupby("run_id").cumcount()
    schema = "run_id long, metric string, t double, value double, seq long"
    path = scratch_path(spark, "fed")
    for part in np.array_split(pdf, 4):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.createDataFrame(pdf, schema), stream


def same(a, b, value):
    key = ["run_id", "t"]
    a, b = (x.select(*key, value).toPandas().sort_values(key).reset_index(drop=True) for x in (a, b))
    assert len(a) == len(b)
    np.testing.assert_allclose(a[value], b[value], rtol=1e-9)


def test_low_pass_goes_on_over_batches(spark, fed):
    whole, stream = fed
    got = sinks.drain(stateful.low_pass_stream(stream(), 10, 333), "lp")
    same(got, batch.low_pass(whole, 10, 333), "filtered")
    assert got.agg(F.sum("late")).first()[0] == 0


def test_energy_goes_on_over_batches(spark, fed):
    whole, stream = fed
    same(sinks.drain(stateful.energy_stream(stream()), "en"), batch.energy(whole), "energy")


def test_cpu_load_goes_on_over_batches(spark, fed):
    whole, stream = fed

    def counters(df):
        cells = {c: F.lit(0).cast("long") for c in batch.COUNTERS}
        cells.update(user=F.floor(F.col("t") * 7).cast("long"), idle=F.floor(F.col("t") * 5 + F.col("run_id")).cast("long"))
        return df.withColumns({**cells, "cpu": F.lit(0)})

    same(sinks.drain(stateful.cpu_load_stream(counters(stream())), "cl"), batch.cpu_load(counters(whole)), "load")


@pytest.mark.parametrize("catch_up", [True, False])
def test_throttle_against_the_loop(spark, fed, catch_up):
    whole, stream = fed
    got = sinks.drain(stateful.throttled(stream(), 1.5, catch_up), "th").toPandas()
    for run, rows in whole.toPandas().groupby("run_id"):
        times = sorted(rows.t)
        mark, want = times[0], []
        for t in times:
            if (t > mark + 1.5) if catch_up else (t - mark >= 1.5):
                want.append(t)
                mark = mark + 1.5 if catch_up else t
        assert sorted(got[got.run_id == run].t) == pytest.approx(want)


def test_late_rows_are_counted(spark):
    schema = "run_id long, metric string, t double, value double"
    path = scratch_path(spark, "late")
    for rows in ([(1, "p", 10.0, 1.0), (1, "p", 11.0, 1.0)], [(1, "p", 5.0, 9.0), (1, "p", 12.0, 1.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = sinks.drain(stateful.energy_stream(stream, 1.0), "le").orderBy("t").collect()
    assert [r.t for r in got] in ([10.0, 11.0, 12.0], [5.0, 10.0, 11.0, 12.0])
    if len(got) == 3:
        assert got[-1].late == 1 and got[-1].energy == pytest.approx(2.0)


def test_windowed_stream_equals_batch(spark, fed):
    whole, stream = fed
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("t"))).withColumn("event_id", F.col("seq"))
    for fn in (windows.sync_sample_stream, windows.sample_per_period):
        closed = sinks.drain(fn(stamp(stream()), 5.0), "win")
        want = fn(stamp(whole), 5.0)
        got, all_rows = set(map(tuple, closed.collect())), set(map(tuple, want.collect()))
        # The last windows stay open behind the watermark.
        assert got <= all_rows and len(got) > len(all_rows) * 0.7


def test_latest_stream_equals_batch(spark, fed):
    whole, stream = fed
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("t")))
    out = sinks.drain(windows.latest(stamp(stream()), ["run_id"]), "lat", "update")
    newest = out.groupBy("run_id").agg(F.max_by("value", "batch").alias("value"))
    assert set(map(tuple, newest.collect())) == set(map(tuple, windows.latest(stamp(whole), ["run_id"]).select("run_id", "value").collect()))


CELLS = ['plain', 'a "x"', ",", "x,y", '"', '""', "one\ntwo", '\n', "\n\n#\n", 'say "hi\nthere", ok', "cr\rlf\r\nend", '#"\n#', "é\nü", "1\n2,3", 'end"\n']


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"' if any(c in cell for c in ',"\r\n') else cell


def hard_file(end="\n"):
    lines = ['# Generated by: run "odd', 'time/ms,v/m°C,"a ""b"", c",w']
    want = []
    for i, cell in enumerate(CELLS):
        lines.append(f"{i * 1000},{i * 1000},{quoted(cell)},{quoted(CELLS[-1 - i]) if i % 3 == 0 else ''}")
        want += [(i, float(i), "v", "°C", float(i), None), (i, float(i), 'a "b", c', "no unit", None, cell)]
        if i % 3 == 0:
            want.append((i, float(i), "w", "no unit", None, CELLS[-1 - i]))
        if i % 4 == 2:
            lines.append('# a remark "with one quote')
    return end.join(lines) + end, sorted(want, key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_cells_at_every_cut(spark, tmp_path, end):
    text, want = hard_file(end)
    path = write(tmp_path, "x", "")
    (tmp_path / "x").write_bytes(text.encode())
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    size = len(text.encode())
    try:
        for split in ([5, 17, 64, size // 2, size + 1] if end == "\n" else [31]):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            got = runfiles.read_runs(spark, path)
            rows = sorted(((r.seq, r.t, r.metric, r.unit, r.value, r.text) for r in got.samples.collect()), key=str)
            assert rows == want, split
            assert [r.n_rows for r in got.runs.collect()] == [len(CELLS)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_written_line_breaks_read_back(spark):
    rows = [("r", i, float(i), "note", None, c) for i, c in enumerate(CELLS)]
    samples = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double, text string")
    columns = spark.createDataFrame([("r", 1, 'no\nte,"', "note")], "run_id string, pos int, raw_name string, metric string")
    runs = spark.createDataFrame([("r", "1")], "run_id string, version string").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("string").alias("zone"), F.lit("x").alias("command"))
    path = scratch_path(spark, "breaks")
    runfiles.write_runs(samples, columns, runs, path)
    back = runfiles.read_runs(spark, path)
    assert sorted((r.seq, r.text) for r in back.samples.collect()) == list(enumerate(CELLS))
    assert {r.raw_name for r in back.columns.collect()} == {"time/ms", 'no\nte,"'}


def test_a_stray_quote_in_a_bare_cell_opens_nothing(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'time/ms,a,b\n0,5" disk,1\n1000,x,2\n2000,"open\n3000,y,4\n')
    got = {(r.seq, r.metric): r.text or r.value for r in runfiles.read_runs(spark, path).samples.collect()}
    assert got[0, "a"] == '5" disk' and got[1, "b"] == 2.0 and (3, "a") not in got


def test_files_cut_otherwise_later_fail(spark, tmp_path):
    path = write(tmp_path, "long.csv", "time/ms,v\n" + "".join(f"{i},{i}\n" for i in range(3000)))
    got = runfiles.read_runs(spark, path)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        with pytest.raises(Exception, match="cut into other blocks"):
            got.samples.count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_growing_files_are_read_once(spark, tmp_path):
    """Files grow between triggers, mid-line and mid-cell; every record comes once, and in the end as the batch reader has it."""
    text, _ = hard_file()
    whole = {"a.csv": text, "b.csv": "time/ms,v/m°C\n" + "".join(f"{i * 10},{i}\n" for i in range(500)), "run_id=7/part-1.csv": "# x\ntime/ms,p\n1,2\n",
             "run_id=7/part-2.csv": "3,4\n5,6\n"}
    path = tmp_path / "live"
    out, state = scratch_path(spark, "tail"), scratch_path(spark, "tail-state")

    def run():
        rows = tail.follow_runs(spark, str(path), split=400)
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()

    for part in (0.0, 0.13, 0.5, 0.51, 0.87, 1.0):
        for name, t in whole.items():
            raw = t.encode()
            (path / name).parent.mkdir(parents=True, exist_ok=True)
            (path / name).write_bytes(raw[:int(len(raw) * part)])
        run()
    key = ["run_id", "t", "metric", "unit", "value", "text"]
    got, want = spark.read.parquet(out), runfiles.read_runs(spark, str(path)).samples
    tidy = lambda df: sorted((str(r.run_id).removeprefix("file:").replace("//", ""), *tuple(r)[1:]) for r in df.select(*key).fillna({"text": "-", "value": -1.0}).collect())
    assert tidy(got) == tidy(want)
    order = {(r.file.split("/")[-1], r["at"]): r.t for r in got.collect()}
    b = [t for (f, _), t in sorted(order.items()) if f == "b.csv"]
    assert b == sorted(b) and len(b) == 500


def test_a_trigger_takes_a_bounded_part(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "time/ms,v\n" + "".join(f"{i},{i}\n" for i in range(2000)))
    out, state = scratch_path(spark, "bounded"), scratch_path(spark, "bounded-state")
    query = (tail.follow_runs(spark, str(tmp_path / "in"), max_bytes=5000).writeStream.format("parquet").option("checkpointLocation", state).start(out))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == 2000
    assert query.lastProgress is None or len(query.recentProgress) > 2


def test_run_files_are_named_as_spark_names_them_and_start_no_processes(spark):
    """Hadoop's writer on a disk starts processes for every file and leaves a checksum file beside it."""
    ids = ["plain", "a/b=c:d", "", None, "ü %[x]^{", "two words"]
    rows = [(r, i, float(i), "v", float(i), None) for r in ids for i in range(5)]
    samples = spark.createDataFrame(rows, "run_id string, seq long, t double, metric string, value double, text string")
    columns = spark.createDataFrame([(r, 1, "v", "v") for r in ids], "run_id string, pos int, raw_name string, metric string")
    runs = spark.createDataFrame([(r, "1") for r in ids], "run_id string, version string").select(
        "*", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("string").alias("zone"), F.lit("x").alias("command"))

    path, plain = scratch_path(spark, "ours"), scratch_path(spark, "plain")
    kept = F.coalesce(F.col("run_id"), F.lit("?")) != ""
    given = [df.where(kept) for df in (samples, columns, runs)]
    runfiles.write_runs(*given, path, block_rows=3)
    lines = runfiles.run_lines(*given, 3).withColumn("part", F.format_string("%08d", "part"))
    lines.repartition("run_id", "part").sortWithinPartitions("run_id", "part", "seq").select("value", "run_id", "part").write.partitionBy("run_id", "part").text(plain)
    read = lambda top: {str(f.parent.relative_to(top)): f.read_text() for f in Path(top).rglob("*.txt")}
    assert read(path) == read(plain) and len(read(path)) == 10
    assert not [f for f in Path(path).rglob("*") if f.name.startswith((".", "_")) or f.suffix == ".crc"]
    runfiles.write_runs(*given, path, block_rows=3, mode="overwrite")
    assert read(path) == read(plain)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        runfiles.write_runs(*given, path, block_rows=3)


def test_the_stream_finds_files_in_folders(spark, tmp_path):
    for i in range(3):
        write(tmp_path / "in" / f"run_id={i}" / "part=0", "a.txt", f"time/ms,v\n0,{i}\n")
    out, state = scratch_path(spark, "deep"), scratch_path(spark, "deep-state")
    rows = runfiles.read_runs_stream(spark, str(tmp_path / "in"))
    rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == [0.0, 1.0, 2.0]


def test_small_files_share_partitions(tmp_path):
    """Planning looks at each file once, and a partition reads many."""
    for i in range(400):
        write(tmp_path / f"run_id={i}", "a.csv", f"time/ms,v\n0,{i}\n")
    reader = tail.RunTailReader({"path": str(tmp_path)})
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) < 10
    cells = [c for p in parts for b in reader.read(p) for c in b.column("cell").to_pylist()]
    assert sorted(map(int, cells)) == list(range(400))


def test_whole_records_agree_with_a_walk_over_lines():
    import random
    pick = random.Random(5)
    for _ in range(300):
        text = "".join(pick.choice(["1,2\n", '1,"a""b"\n', '1,"x\ny"\n', '2,5" disk\n', '"\n', ',"\n', "# \"\n", "\n", "3"]) for _ in range(pick.randint(0, 30))).encode()
        size = pick.choice([3, 7, 64])
        pieces = lambda: (text[i:i + size] for i in range(0, len(text), size))
        for most in (None, 1, 9, 40):
            end, cuts = 0, [0]
            for begin, end, _ in tail.records(pieces(), 0, b"#"):
                if begin - cuts[-1] >= 8:
                    cuts.append(begin)
                if most is not None and end >= most:
                    break
            assert tail.whole_records(pieces(), 0, b"#", 8, most) == (end, cuts), (text, size, most)


ODD_NAMES = ["a b.csv", "run_id=ü é%/p#1.csv", "run_id=x%2Fy/part=0/f.txt", "run_id=q'[]{}^`|\"<>/z.csv", "_x/h.csv", ".h/i.csv", "_k=1/a.csv", "u\u00a0v\u3000/t.csv",
             "d/e/f/~!$&()*+,;=@.csv", "c._COPYING_", "tab\tx.csv", "o/1.txt", "o/2.txt", "o/3.txt", "o/run_id=4/part=1/4"]
BYTES = [b"", b"\xef\xbb\xbfa,b\n1,2\n", b"x\n\n\ny", b"q\r\nw\r\n\n", b"\xff\xfe bad\nk" + b"z" * 100 + b"\nlast"]


@pytest.mark.parametrize("cut, most", [(runfiles.CUT_BYTES, runfiles.LISTED), (7, 1), (1, 2)])
def test_tasks_read_files_as_spark_does(spark, tmp_path, cut, most):
    for i, name in enumerate(ODD_NAMES):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(BYTES[i % 5] + f"n{i}\n".encode() * (i % 3))

    def rows(lines, order):
        got = {}
        for r in lines.withColumn("line", F.col("line").cast("binary")).collect():
            got.setdefault((r.run_id, r.file), []).append((*(r[c] for c in order), bytes(r.line)))
        return {k: [x[-1] for x in sorted(v)] for k, v in got.items()}

    assert rows(runfiles._stored_lines(spark, [str(tmp_path)], cut, most), ["start", "id"]) == rows(runfiles._lines(spark, str(tmp_path)), ["id"])


def test_many_files_are_opened_once(spark, tmp_path):
    for i in range(runfiles.MANY):
        (tmp_path / f"run_id={i}").mkdir()
        (tmp_path / f"run_id={i}" / "x.csv").write_text(f"# Version: {i}\ntime/ms,v/m°C,note\n0,{i * 1000},\n1000,,\"a\n,{i}\"\n")
    got = runfiles.read_runs(spark, str(tmp_path))
    assert "FileScan text" not in got.samples._jdf.queryExecution().toString()
    rows = {(r.run_id, r.seq, r.t, r.metric, r.unit, r.value, r.text) for r in got.samples.collect()}
    assert rows == {x for i in range(runfiles.MANY) for x in ((str(i), 0, 0.0, "v", "°C", float(i), None), (str(i), 1, 1.0, "note", "no unit", None, f"a\n,{i}"))}
    assert {(r.run_id, r.version, r.n_rows) for r in got.runs.collect()} == {(str(i), str(i), 2) for i in range(runfiles.MANY)}


def test_offsets_and_plans_do_not_grow_with_the_names_of_files(tmp_path):
    """The driver holds offsets in its log and its progress, and the partitions of a trigger."""
    import json
    import pickle

    for i in range(400):
        write(tmp_path / "in" / f"run_id={i}" / "part=0", "a.csv", f"time/ms,v\n0,{i}\n")
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "ends")}
    cells = lambda reader, parts: sorted(int(c) for p in parts for b in reader.read(p) for c in b.column("cell").to_pylist())
    reader = tail.RunTailReader(options)
    first = reader.latestOffset()
    assert len(json.dumps(first)) < 500 and reader.latestOffset() == first
    parts = reader.partitions({}, first)
    assert sum(len(pickle.dumps(p)) for p in parts) < 400 * 50
    assert cells(reader, parts) == list(range(400))
    for i in range(0, 400, 100):
        with open(tmp_path / "in" / f"run_id={i}" / "part=0" / "a.csv", "a") as f:
            f.write(f"1,{1000 + i}\n2,")
    second = reader.latestOffset()
    assert second != first
    again = tail.RunTailReader(options)  # after a restart
    named = {f"{tmp_path}/in/run_id={i}/part=0/a.csv": len(f"time/ms,v\n0,{i}\n") for i in range(400)}  # as offsets of older queries are
    for one, start in ((reader, first), (again, first), (tail.RunTailReader(options), named)):
        assert cells(one, one.partitions(start, second)) == [1000, 1100, 1200, 1300]
    assert cells(again, again.partitions({}, second)) == [*range(400), 1000, 1100, 1200, 1300]
    reader.commit(second)


def test_bytes_are_counted_without_a_list_on_the_driver(spark, tmp_path, monkeypatch):
    for i in range(30):
        write(tmp_path / f"run_id={i}" / "part=0", "a.txt", "time/ms,v\n" + "0,ü\n" * i)
    want = sum(f.stat().st_size for f in tmp_path.rglob("*.txt"))
    monkeypatch.setattr(type(spark.read), "text", None)
    assert runfiles.stored_bytes(spark, str(tmp_path)) == runfiles.stored_bytes(spark, f"file://{tmp_path}") == want
