"""What is small is planned once, and what is large is not shuffled to meet it."""

import re

import numpy as np
import pandas as pd
from conftest import note
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import blockmax, context, ivf, keyword, vector
from quillspark.plans import catalog
from quillspark.sources import driver_tables as D

NOW = "2026-08-01 00:00:00"


def shuffled(df):
    """The columns of each shuffle."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [set(re.findall(r"(\w+)#", cols)) for cols in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def corpus(spark, tmp_path):
    docs = [(i, f"alpha beta gamma{i} delta epsilon{i % 3} zeta", "en", "a.org") for i in range(12)]
    spark.createDataFrame(docs + docs[:1], "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "beta gamma4 delta"), (1, "delta epsilon2 zeta"), (2, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return catalog.Corpus(spark, str(tmp_path))


def test_gold_and_routes_are_stored_once(spark, tmp_path, monkeypatch):
    """pin_harm, strata, parity_delta, misses, mode_compare: parts that several modes read."""
    c = corpus(spark, tmp_path)
    made = []
    monkeypatch.setattr(catalog.D, "gold", lambda *a, plan=D.gold: made.append(1) or plan(*a))
    found = {(r.case_id, r.path) for r in c.gold.collect()}
    assert {q for q, _ in found} == {0, 1} and len([p for q, p in found if q == 1]) == 4
    assert c.brief_map.count() > 0 and c.cases.count() == 3 and len(made) == 1
    for rows in (c.gold, c.brief_map, c.routes("topic"), c.semantic):
        assert all("/quillspark/" in f for f in rows.inputFiles())
    assert c.routes("topic").inputFiles() == c.routes("topic").inputFiles() != c.routes("query").inputFiles()


def test_gold_shuffles_no_text(spark, tmp_path):
    """strata, recall_text: candidates are few, so documents stay; rows that come twice count as before."""
    corpus(spark, tmp_path)
    gold = D.gold(spark, str(tmp_path))
    with_text = [cols for cols in shuffled(gold) if "passage" in cols or {"path", "text"} <= cols]
    assert not with_text
    assert gold.where("case_id = 1").count() == 4
    assert gold.where("case_id = 0").count() == 1


def test_blocks_are_not_shuffled_to_meet_many_asked_words(spark, vault, tmp_path, monkeypatch):
    files = {f"n{i}.md": note(f"Note {i % 5}", ("type/brief",), " ".join(f"word{(i * k) % 17}" for k in range(1, 9))) for i in range(40)}
    stored = blockmax.publish(vault(files), str(tmp_path), shards=3, notes_per_range=4)
    q = spark.createDataFrame([(1, "word3 word5"), (2, "wor note"), (3, "nothing")], "query_id int, query string")
    want = sorted(map(tuple, stored.search(q, NOW, limit=5).select("query_id", "path", "score", "rank").collect()))
    stored.asked.clear()
    monkeypatch.setattr(blockmax, "BROADCAST_ASKS", 0)
    passes = []
    held = keyword.top_k
    monkeypatch.setattr(keyword, "top_k", lambda rows, *a: passes.append(rows) or held(rows, *a))
    assert sorted(map(tuple, stored.search(q, NOW, limit=5).select("query_id", "path", "score", "rank").collect())) == want
    assert {r[0] for r in want} == {1, 2}
    assert shuffled(passes[0]) and not any("docs" in cols for cols in shuffled(passes[0]))


def _vectors(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{key} long, vector array<double>")


def test_nearest_reads_items_where_they_are(spark, monkeypatch):
    """The same rows as by tiles, ties in the order of items; vectors are shuffled by tiles alone."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(200, 6))
    rows[50:120] = rows[50]
    items, queries = _vectors(spark, rows, "item_id").repartition(5), _vectors(spark, rows[45:53], "query_id")
    near = vector.nearest(queries, items, 4)
    got = sorted(map(tuple, near.collect()))
    assert [r[1] for r in got if r[0] == 5] == [50, 51, 52, 53] or {r[1] for r in got if r[0] == 5} == {50, 51, 52, 53}
    assert not any({"item_id", "vector", "cb"} <= cols for cols in shuffled(near))
    assert "CoGroup" not in near._jdf.queryExecution().toString()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    tiled = vector.nearest(queries, items, 4)
    assert "CoGroup" in tiled._jdf.queryExecution().toString()
    assert sorted(map(tuple, tiled.collect())) == got
    assert vector.nearest(queries.limit(0), items, 4).count() == 0


def test_a_query_goes_once_to_a_tile(spark, tmp_path, monkeypatch):
    """ann_recall: rows of a query are as many as tiles, not as the lists it probes, and few are made at once."""
    rng = np.random.default_rng(6)
    items = _vectors(spark, rng.normal(size=(900, 8)), "item_id")
    index = ivf.publish(items, str(tmp_path / "v"))
    tiles = ivf.Tiles.of(np.array([30, 0, 20, 130, 10, 45]), 50)
    assert tiles.low.tolist() == [0, 3, 3, 3, 4, 5] and tiles.high.tolist() == [3, 4, 4, 4, 5, 6]
    assert tiles.first.tolist() == [0, 0, 0, 1, 4, 5] and tiles.pieces.tolist() == [1, 0, 1, 3, 1, 1]
    sizes = np.zeros(len(index.model.centroids), int)
    for r in index.codes.groupBy("list_id").count().collect():
        sizes[r["list_id"]] = r["count"]
    tiles = ivf.Tiles.of(sizes, 300)
    queries = _vectors(spark, rng.normal(size=(40, 8)), "query_id")
    rows = ivf.probes(queries, index.model, tiles).collect()
    assert index.model.probes > len(tiles.low) and len(rows) <= 40 * len(tiles.low)
    assert all(sum(len(r["lists"]) for r in rows if r["query_id"] == q) == index.model.probes for q in range(40))
    monkeypatch.setattr(ivf, "PROBED", 5)
    few = ivf.probes(queries, index.model, tiles).collect()
    assert sorted((r["query_id"], r["tile"], r["lists"]) for r in few) == sorted((r["query_id"], r["tile"], r["lists"]) for r in rows)


def test_many_ties_are_held_to_k_a_block():
    q, c = np.eye(2), np.tile([1.0, 0.0], (5000, 1))
    row, col, _ = vector._best(q, c, 3, 256, 512)
    assert row.tolist() == [0, 0, 0, 1, 1, 1] and col.tolist() == [0, 1, 2, 0, 1, 2]


def test_gate_and_snippet_on_whole_words(spark):
    rows = [("alpha beta", "x", "Alpha_ beta"), ("alpha beta", "x", "ALPHA, (beta)"), ("alpha beta", "Beta", None), ("alpha beta", "x", None), ("a-b2 c3", "x", "éb2 c3")]
    df = spark.createDataFrame(rows, "p string, t string, c string")
    ok = df.select(context.shares_content(F.col("p"), F.col("t"), F.col("c")).alias("ok"))
    assert [r["ok"] for r in ok.collect()] == [False, True, True, False, True]
    body = "x" * 300 + " Needle " + "y" * 300
    s = spark.createDataFrame([(body, ["type/note"], "needle haystack")], "c string, t array<string>, q string").select(text.snippet("c", "t", "q").alias("s")).first()["s"]
    assert s == "..." + "x" * 79 + " Needle " + "y" * 113 + "..." and pd.notna(s)
