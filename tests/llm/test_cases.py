"""The cases every operator on texts has to stand: nulls, empty and very long texts, repeated rows, extra columns; and base columns in SQL."""

import random

import duckdb
import pytest

from runlens.llm.oracles import CRC32
from runlens.llm.queries import QUERIES

TEXTS = [n for n in QUERIES if n.split("_")[0] not in ("op8", "op11")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(15, 60)), "en", f"s{i % 2}", 5, "x", 1, 1.0, "c") for i in range(20)]
    rows += [(100, prose(160_000), "en", "s0", 1, "x", 1, 1.0, "c"), (101, "q" * 1_100_000, None, "s0", 1, None, None, None, None),
             (102, None, None, None, None, None, None, None, None), (103, "", "en", "s1", 0, "x", 1, 1.0, "c"), (104, " \n\t ", "en", None, 4, "x", 1, 1.0, "c"),
             (105, "Ünï çödé 漢字 \u0000 end", "de", "s1", None, "x", 1, 1.0, "c"), (None, "a row without an id", "en", "s1", 3, "x", 1, 1.0, "c")]
    rows += [rows[0], rows[0], (200, rows[1][1], "en", "s0", 9, "y", 2, 2.0, "d")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank int, score double, held_out string"
    path = tmp_path_factory.mktemp("cases")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(20)] + [(None, 1, 1), (7, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(path / "labels.parquet"))
    return str(path), len(rows)


@pytest.mark.parametrize("name", TEXTS)
def test_hard_rows(spark, sf, name):
    path, n = sf
    found = QUERIES[name](spark, path)
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    if name.startswith("op10"):
        assert set(ids) == {*range(20), *range(100, 106), 200, None}
    else:
        assert len(ids) == n and ids.count(0) == 3 and ids.count(None) == 1


@pytest.fixture(scope="module")
def short(spark, sf, tmp_path_factory):
    """The same rows without the very long texts."""
    path = tmp_path_factory.mktemp("short")
    for table in ("documents", "labels"):
        spark.read.parquet(f"{sf[0]}/{table}.parquet").where("doc_id IS NULL OR doc_id NOT IN (100, 101)").write.parquet(str(path / f"{table}.parquet"))
    return str(path)


def connected(path):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    return con


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def test_base_columns_of_the_quality_rules_in_sql(spark, short):
    sql = f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
      p AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS five FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
      t AS (SELECT r, i FROM p QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
      c AS (SELECT r, count(DISTINCT i + k) AS n FROM t, range(5) AS x(k) GROUP BY r),
      l AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r)
      SELECT doc_id, len(ws), coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0), len(regexp_extract_all(text, '[#*$%&|<>]')), coalesce(l.n, 0), coalesce(c.n, 0)
      FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)"""
    want = sorted(((a, int(b), int(c), int(d), int(e), int(f)) for a, b, c, d, e, f in connected(short).execute(sql).fetchall()), key=str)
    got = QUERIES["op3_quality_rules"](spark, short).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_base_score_in_sql(spark, short):
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = CRC32.format("doc_id::VARCHAR")
    sql = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, doc_id IS NOT NULL AND {crc} % 10 = 0 AS held, list_append({WORDS.replace("coalesce(text, '')", lower)}, chr(10)) AS ws FROM documents),
      t AS (SELECT r, doc_id, held, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
      SELECT doc_id, held, count(*), count(c.c), max(n.n), sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))) FROM t LEFT JOIN c USING (w) CROSS JOIN n GROUP BY r, doc_id, held"""
    want = sorted(connected(short).execute(sql).fetchall(), key=str)
    got = sorted(map(tuple, QUERIES["op1_suffix_tree"](spark, short).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()), key=str)
    assert [x[:5] for x in got] == [(a, b, int(c), int(d), int(e)) for a, b, c, d, e, _ in want]
    assert all(x[5] == pytest.approx(y[5], rel=1e-9) for x, y in zip(got, want))
