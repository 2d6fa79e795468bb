"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import bagminhash, curriculum, html_extract, license_join, line_quality, packing, suffix_dedup, toxicity, vamana, warc
from siltstone.llm.common import shared_path
from siltstone.llm.queries import TOKENIZER

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, kept string, label string, value int, node string, bucket int, target int"
EXTRA = (1.5, "s", "k", "l", 3, "n", 7, 8)
LONG = " ".join(f"word{i % 7919} is {i}" for i in range(60_000))
GOOD = "Some plain words make up this line of the text and it ends well.\nAnother line with other words follows it here, and more of them come.\n" + " ".join(f"w{i}" for i in range(60)) + "."


def documents(spark):
    rows = [
        (1, GOOD, "en", "a", 10), (2, None, "en", "a", 0), (3, "", None, "b", 0), (None, GOOD, "en", None, 5), (None, None, None, None, None), (4, LONG, "en", "b", None),
        (5, GOOD, "en", "c", 10), (5, GOOD, "en", "c", 10), (6, "x", "en", "a", 1), (6, "y" * 300, "en", "a", 1), (7, " \n\t ", "en", "a", 4), (8, "\x00\x01   é 漢字 🙂 " + GOOD, "en", "a", 9), (9, "z" * 200_000, "en", "d", 9),
    ]
    return spark.createDataFrame([r + EXTRA for r in rows], SHAPE)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (6, 0, 1), (8, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def pages(spark):
    html = "<html><body><nav><a href='/'>Home</a></nav><article><p>Main  text &amp; more of it here.</p></article></body></html>"
    rows = [(1, "u", html), (2, None, None), (3, "a\r\nb", ""), (4, "u", html), (4, "u", html), (None, "u", html), (5, "u", "<p " * 2000), (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"), (7, "u", "<p>" + "t " * 100_000), (8, "u", "<script>never closed")]
    return spark.createDataFrame([r + ("clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int")


def embeddings(spark):
    good = [1.0, 2.0, 3.0]
    rows = [(100, good), (200, good), (1, good), (2, [1.0, 2.0, 4.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (None, good), (8, [1.0]), (300, [5.0]), (2, [1.0, 2.0, 4.0])]
    return spark.createDataFrame([r + (1, "c") for r in rows], "vec_id long, embedding array<float>, label int, shard string")


MODEL = line_quality.chain.train([__import__("numpy").array(line_quality.lines_of(t)[0]) for t in (GOOD, "BAD!! BAD!!\nBAD!! BAD!!")], [__import__("numpy").array([1, 1, 1]), __import__("numpy").array([0, 0])])


def test_toxicity(spark):
    docs = documents(spark)
    for held in (docs, docs.limit(0)):
        out = toxicity.score(held, toxicity.train(held, labels(spark))).collect()
        assert len(out) == held.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


@pytest.mark.parametrize("model", [MODEL, None])
def test_line_quality(spark, model):
    docs = documents(spark)
    out = {r["doc_id"]: r for r in line_quality.judge(docs, model).collect()}
    assert out[2]["n_words"] == 0 and out[2]["base_failed"] and not out[2]["kept"]
    assert out[1]["kept"] and out[4]["n_words"] == 180_000
    kept = line_quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 2
    assert line_quality.judge(docs.limit(0), model).count() == 0
    assert line_quality.fit(docs.limit(0), labels(spark)) is None


def test_near_duplicates(spark):
    docs = documents(spark)
    out = bagminhash.classes(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by[5] == {1} and by[2] == {2} and by[3] == {3} and by[7] == {7} and by[None] == {1, None}
    kept = bagminhash.keep(docs)
    assert kept.columns == docs.columns
    # 8 is 1 with a few words before it; the two texts of 6 are two classes
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (1, GOOD), (2, ""), (3, ""), (4, LONG), (6, "x"), (6, "y" * 300), (7, " \n\t "), (9, "z" * 200_000)]
    assert bagminhash.classes(docs.limit(0)).count() == 0 and bagminhash.keep(docs.limit(0)).count() == 0


def test_near_duplicates_keep_rows_not_ids(spark):
    """A repeated id with different texts loses none that is its class's only one; equal rows, and rows equal but for other columns, leave one."""
    shape = "doc_id long, text string, `a.b` string, _key string, root int"
    rows = [(3, "A", "x", "k", 1), (5, "A", "x", "k", 1), (5, "B", "x", "k", 1), (5, "B", "x", "k", 1), (7, "C", "q", "k", 1), (7, "C", "p", "k", 1), (None, "C", "x", "k", 1), (None, "D", "x", "k", 1), (None, "D", "x", "k", 1), (2**62, "E", None, None, None)]
    want = sorted([(3, "A", "x"), (5, "B", "x"), (7, "C", "p"), (0, "D", "x"), (2**62, "E", "")])
    for n in (1, 4):
        out = bagminhash.keep(spark.createDataFrame(rows, shape).repartition(n))
        assert out.columns == ["doc_id", "text", "a.b", "_key", "root"] and sorted((r[0] or 0, r[1], r[2] or "") for r in out.collect()) == want


@pytest.mark.parametrize("order", [1, -1])
def test_suffix_dedup_of_any_ids(spark, order):
    """Large, repeated and null ids: the order is that of the ids, null ones last."""
    rows = [(2**62, "a" * 120), (2**62, "b" * 120), (2**62 + 7, GOOD + "!"), (None, GOOD + "!"), (None, "b" * 120), (-(2**63), "q" * 99), (2**63 - 1, GOOD + "!"), (2**63 - 1, GOOD + "!")][::order]
    out = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_removed"]) for r in suffix_dedup.find(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(GOOD) + 1
    # One letter repeated 120 times repeats itself from its second byte on.
    assert out == sorted([(2**62, 120, 119), (2**62, 120, 119), (2**62 + 7, n, 0), (0, n, n), (0, 120, 120), (-(2**63), 99, 0), (2**63 - 1, n, n), (2**63 - 1, n, n)])


def test_suffix_dedup(spark):
    docs = documents(spark)
    out = suffix_dedup.find(docs).collect()
    assert len(out) == docs.count()
    five = sorted((r["n_bytes"], r["n_removed"]) for r in out if r["doc_id"] == 5)
    assert five == [(len(GOOD), len(GOOD))] * 2  # document 1 has it
    assert [r["n_removed"] for r in out if r["doc_id"] == 9] == [199_999]
    kept = suffix_dedup.remove(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 0 and kept.filter("doc_id = 1").first()["text"] == GOOD
    assert suffix_dedup.find(docs.limit(0)).count() == 0 and suffix_dedup.remove(docs.limit(0)).count() == 0


def test_warc(spark):
    held = pages(spark)
    out = warc.round_trip(held, shared_path(spark, "test")).collect()
    assert len(out) == held.count()
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in out if r["payload_bytes"] > 100 and r["page_id"] in (1, 4, None))
    assert kinds == [(0, "revisit", 1), (1, "response", None), (4, "revisit", 1), (4, "revisit", 1)]
    assert [(r["record_type"], r["payload_bytes"]) for r in out if r["page_id"] == 2] == [("response", 0)] and [r["refers_to"] for r in out if r["page_id"] == 3] == [2]
    assert warc.round_trip(held.limit(0), shared_path(spark, "test")).count() == 0


def test_neighbours(spark):
    out = vamana.search(embeddings(spark)).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    assert got == {(100, 1): (1, 0.0), (100, 2): (200, 0.0), (100, 3): (2, 1.0), (200, 1): (1, 0.0), (200, 2): (100, 0.0), (200, 3): (2, 1.0), (300, 1): (8, 4.0)}
    assert vamana.search(embeddings(spark).limit(0)).count() == 0


def test_main_text(spark):
    out = {r["page_id"]: r for r in html_extract.extract(pages(spark)).collect()}
    assert out[1]["text"] == "Main text & more of it here." and out[2]["text"] == "" and out[2]["n_chars"] == 0 and out[8]["text"] == ""
    assert html_extract.extract(pages(spark).limit(0)).count() == 0


def test_license(spark):
    docs = documents(spark)
    out = license_join.scan(docs).collect()
    assert len(out) == docs.count()
    assert all(r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in out)
    assert license_join.scan(docs.limit(0)).count() == 0
    assert license_join.scan(docs, templates={}).count() == docs.count()


def test_license_wrapped(spark):
    """Notices in their usual wrapping, after a comment sign, and a word a line, and over empty lines; a template's words far apart are none."""
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"
    mit = "Intro.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"
    split = "Permission is hereby granted, free of charge,\n\nto any person obtaining a copy\n\nof this software and associated documentation files"
    apart = "Released late.\n" + "filler words go on and on " * 4 + "\nunder the\n" + "filler words go on and on " * 4 + "\nlicense"
    texts = [gpl, mit, bsd, bsd.replace("\n", "\n# "), mit.replace(" ", "\n"), split, apart]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in license_join.scan(docs).collect()}
    assert out == {0: ("gpl,gpl-notice", 1.0), 1: ("mit-text", 1.0), 2: ("bsd", 1.0), 3: ("bsd", 1.0), 4: ("mit-text", 1.0), 5: ("mit-text", 1.0), 6: ("", 0.0)}


def test_license_needs_the_telling_words_close_together(spark):
    """Another license's name or version, and a template's words that are spread over more words than it has, match nothing."""
    texts = [
        "the court released him under bail and the mit student paid", "GNU General Public License version 2", "Released under the Apache License.", "Licensed under CC BY 4.0.", "licensed under the Mozilla Public License, version 2.0",
        "Released under the MIT License.", "x " * 30 + "released under\nthe MIT\nlicense", "GNU General Public License, version 3", "under the MIT License",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["labels"] for r in license_join.scan(docs).collect()}
    assert out == {0: "", 1: "gpl", 2: "apache", 3: "cc-by", 4: "", 5: "mit,mit-text", 6: "mit,mit-text", 7: "gpl,gpl-3.0", 8: "mit,mit-text"}


def test_license_runs_over_block_edges(spark):
    """A notice is found wherever it starts, also where it lies over the edges of blocks."""
    bsd = license_join.TEMPLATES["bsd"][0].split()
    texts = [" ".join(["w"] * n + bsd + ["v"] * 70) for n in range(0, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["labels"] == "bsd" and r["score"] == 1.0 for r in license_join.scan(docs).collect())


def test_mixing(spark):
    docs = documents(spark)
    out = curriculum.mix_plan(docs).collect()
    assert len(out) == docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in out)
    assert curriculum.mix_plan(docs.limit(0)).count() == 0
    assert curriculum.mix(docs).columns == [*docs.columns, "_position"] and curriculum.mix(docs.limit(0)).count() == 0
    odd = docs.withColumns({"_meta": F.lit("m"), "_position": F.col("doc_id"), "a.b": F.lit(1)})
    mixed = curriculum.mix(odd)
    assert mixed.columns == [*odd.columns, "__position"]
    plan = {}
    for r in out:
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    got = mixed.collect()
    assert {i: n for i, n in plan.items() if n} == {i: sum(r["doc_id"] == i for r in got) for i in {r["doc_id"] for r in got}}
    assert all(r["_meta"] == "m" and r["_position"] == r["doc_id"] for r in got)
    places = [r["__position"] for r in got]
    assert places == sorted(places)
    assert curriculum.mix_plan(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_packing(spark):
    docs = documents(spark)
    out = packing.pack(docs, TOKENIZER)
    total = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total[2] == total[3] == 1 and total[5] % 2 == 0 and total[None] > 1
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    docs = documents(spark).withColumns({"_meta": F.lit("m"), "_position": F.lit(2), "_key": F.lit("k")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns and held.filter("_meta <> 'm' OR _position <> 2 OR _key <> 'k'").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_pipeline_on_edges(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    documents(spark).limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    labels(spark).limit(0).write.parquet(f"{tmp_path}/e/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
