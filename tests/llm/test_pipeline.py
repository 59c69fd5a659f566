"""Every stage of the pipeline on its own input."""

import random
import shutil

import pytest

import corpus_pipeline
from runlens.llm import quality_rules


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A small documents table with copies, junk, shared passages, nulls and an extra column, and labels."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = []
    for i in range(120):
        kind = i % 6
        text = prose(rng.randint(40, 200))
        if kind == 1:
            text = rows[rng.randrange(len(rows))][1]  # a copy
        elif kind == 2:
            text = prose(20) + " " + passage + " " + prose(20)
        elif kind == 3:
            text = "junk " * 300
        rows.append((i, text, "en", f"src{i % 3}", len(text or ""), "x"))
    rows += [(200, None, None, None, None, None), (201, "", "en", "s", 0, None), (202, "too short", "en", "s", 9, None)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bands string")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    yield str(path)
    shutil.rmtree(path, ignore_errors=True)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == seen[name][0].columns
    ids = {name: sorted(r.doc_id for r in after.collect()) for name, (_, after) in seen.items()}
    texts = {r.doc_id: r.text for r in seen["quality rules"][0].collect()}
    judged = quality_rules.quality_rules(seen["quality rules"][0])
    assert ids["quality rules"] == sorted(r.doc_id for r in judged.where("kept").collect())
    assert not {200, 201, 202} & set(ids["quality rules"])
    kept = {}
    for i in ids["quality rules"]:
        kept.setdefault(texts[i], i)
    assert ids["near-dedup"] == sorted(kept.values())  # near copies are tested elsewhere; here copies are exact
    assert ids["suffix dedup"] == ids["near-dedup"]
    raws = {i: texts[i].encode() for i in ids["near-dedup"]}
    often = {}
    for r in raws.values():
        for k in range(len(r) - 199):
            often[r[k:k + 200]] = often.get(r[k:k + 200], 0) + 1
    for r in seen["suffix dedup"][1].collect():
        raw, gone = raws[r.doc_id], bytearray(len(raws[r.doc_id]))
        for k in range(len(raw) - 199):
            if often[raw[k:k + 200]] > 1:
                gone[k:k + 200] = b"\x01" * 200
        assert r.text == bytes(b for b, g in zip(raw, gone) if not g).decode() and r.n_chars == len(r.text)
    assert set(ids["mixing"]) <= set(ids["suffix dedup"]) and len(ids["mixing"]) == len(set(ids["mixing"]))
    assert {r.doc_id for r in seen["packing"][1].collect()} == set(ids["mixing"])


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns[:3] == ["doc_id", "start", "length"]


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_mixing_keeps_clean_documents(spark, tmp_path):
    """Toxic words are 0.1 % of the corpus, below their ceiling; poor ones far above theirs."""
    rng = random.Random(5)
    kinds = ["toxic"] + ["poor"] * 200 + ["good"] * 799
    text = lambda kind: " ".join(f"{kind}{rng.randrange(30)}" for _ in range(60))
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    spark.createDataFrame([(i, int(k == "good"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect()}
    by_kind = {k: [i for i in kept if kinds[i] == k] for k in set(kinds)}
    assert len(by_kind["good"]) == 799 and len(by_kind["toxic"]) == 1
    assert len(by_kind["poor"]) < 40
