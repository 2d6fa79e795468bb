"""Cases that once went wrong: other splits at a second read, vectors of any magnitude, columns of any name, long repeats."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import suffix_dedup, vamana, warc
from siltstone.llm.common import shared_path
from test_brute_force import reported
from test_edges import GOOD, labels


@pytest.mark.parametrize("payloads", [True, False])
def test_archives_are_whole_however_they_are_split(spark, payloads):
    """Pages that hold a magic, so that all records are in pieces; the splits change between building and collecting."""
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i} WARC/1.1\r\nContent-Length: {i}\r\n\r\n{'x' * (50 * i)} WARC/1.1\r\n</p>") for i in range(200)], "page_id long, url string, html string").repartition(3)
    path = shared_path(spark, "warc")
    key = "spark.sql.leafNodeDefaultParallelism"
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        warc.write(pages, path)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for before, after in (("4", "16"), ("64", "8")):
            spark.conf.set(key, before)
            held = warc.read(spark, path, payloads)
            spark.conf.set(key, after)
            rows = held.collect()
            assert sorted(r["page_id"] for r in rows) == list(range(200)) and not any(r["error"] for r in rows)
    finally:
        spark.conf.unset(key)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)


@pytest.mark.parametrize("unit", [1e-300, 1e-160, 1e-25, 1.0, 1e21, 1e160, 1e300])
def test_neighbours_at_any_magnitude(spark, unit):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (300, 8)) * unit
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = vamana.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=30)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found.collect()}
    hits = 0
    for q in range(0, 300, 30):
        d = np.sqrt((((x - x[q]) / unit) ** 2).sum(1))
        want = [i for i in np.argsort(d, kind="stable") if i != q][:10]
        hits += sum(got[q, k + 1] == w for k, w in enumerate(want))
    assert len(got) == 100 and hits >= 99


def test_neighbours_of_mixed_magnitudes(spark):
    """A few rows far out must not blur the others, and a query far out finds the nearest of them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (200, 4)), rng.normal(0, 1, (30, 4)) * 1e-20, [[1e30, 0, 0, 0], [1e30, 1e29, 0, 0], [-1e306, 1e306, 0, 0]]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vamana.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, k=3).collect()}
    for q in range(len(x)):
        d = vamana.euclidean(x, x[q])
        want = sorted((s, i) for i, s in enumerate(d.tolist()) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, s) for s, i in want]


def test_distances_beyond_squares():
    assert vamana.euclidean(np.array([[3e200, 0.0], [0.0, 4e200]]), np.array([0.0, 0.0])).tolist() == pytest.approx([3e200, 4e200])
    assert vamana.euclidean(np.array([[3e-200, 4e-200]]), np.zeros(2))[0] == pytest.approx(5e-200)
    assert vamana.euclidean(np.array([[1.5e308]]), np.array([-0.2e308]))[0] == pytest.approx(1.7e308)


NAMES = ("_id", "_hash", "_kept", "_cut", "_doc_id", "_id2", "_hash2", "_place", "_place2", "_row", "a.b", "key", "part", "_position", "_range", "node", "root", "band", "x y", "c0", "k")


def test_columns_of_any_name_go_through_the_pipeline(spark, tmp_path):
    rows = [(i, GOOD + f" And number {i} ends here." * 3, "en", "ab"[i % 2], 10) for i in range(30)] + [(3, GOOD, "en", "a", 1), (3, GOOD, "en", "a", 1), (None, GOOD, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"v{k}").alias(c) for k, c in enumerate(NAMES)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns
        assert all(tuple(r) == tuple(f"v{k}" for k in range(len(NAMES))) for r in held.select(*[F.col(f"`{c}`") for c in NAMES]).collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("length", [294, 295, 400, 1000])
def test_repeats_of_any_length(spark, length):
    rng = random.Random(length)
    part = "".join(rng.choices("abcdefgh", k=length + 40))
    docs = {i: "".join(rng.choices("abcdefgh ", k=rng.randint(0, 900))) + (part[rng.randrange(30) :] if i % 2 else part[: length - 1]) + "".join(rng.choices("xyz", k=rng.randint(0, 200))) for i in range(20)}
    got = suffix_dedup.find(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), length=length)
    assert {tuple(r) for r in got.collect()} == reported({i: t.encode() for i, t in docs.items()}, length)


def test_lengths_that_a_stretch_cannot_hold(spark):
    with pytest.raises(ValueError):
        suffix_dedup.find(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=70_000)
