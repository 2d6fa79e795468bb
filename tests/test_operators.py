"""Operators on worked cases."""

import math
import re

from pyspark.sql import functions as F

from siltstone.functions import exact
from siltstone.operators import alignment, catalog, contracts, orchestration, scoring, store


def test_worked_score(spark):
    """Scores 1, 1, 5 on scales 0-1, 0-2, 1-5 with weights 2, 1, 3."""
    criteria = spark.createDataFrame([(1, "a", 2.0, 0.0, 1.0, False), (2, "b", 1.0, 0.0, 2.0, True), (3, "c", 3.0, 1.0, 5.0, False)], "criterion_order int, criterion_id string, weight double, scale_min double, scale_max double, review_required boolean")
    shape = "call_id int, criterion_order int, criterion_id string, status string, score double, human_review_required boolean"
    scored = spark.createDataFrame([(1, 1, "a", "scored", 1.0, False), (1, 2, "b", "scored", 1.0, False), (1, 3, "c", "scored", 5.0, False), (2, 1, "a", "scored", 1.0, False), (2, 2, "b", "insufficient_evidence", None, False), (2, 3, "c", "scored", 5.0, False), (3, 1, "a", "not_applicable", None, False)], shape)
    rows = {r["call_id"]: r for r in scoring.call_scores(scoring.contributions(scored, criteria)).withColumn("p", scoring.publication()).withColumn("q", scoring.publication(no_review=False)).collect()}
    assert abs(rows[1]["score"] - 5.5 / 6) < 1e-12 and rows[1]["p"] == "human_review_required" and rows[1]["q"] == "publishable"
    assert rows[2]["score"] == 1.0 and abs(rows[2]["weight_coverage"] - 5 / 6) < 1e-12 and abs(rows[2]["criterion_coverage"] - 2 / 3) < 1e-12
    assert rows[3]["score"] is None and rows[3]["weight_coverage"] is None and rows[3]["p"] == "no_scorable_criteria"


def assigned(spark, unit, turns, **options):
    units = spark.createDataFrame([(1, 0, *unit)], "call_id int, unit_order int, start_seconds double, end_seconds double")
    turned = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "call_id int, turn_order int, speaker_label string, start_seconds double, end_seconds double")
    return alignment.assign(units, turned, **options).first()


def test_alignment_cases(spark):
    a, b, c = "SPEAKER_00", "SPEAKER_01", "SPEAKER_02"
    assert assigned(spark, (0.4, 0.6), [(a, 0.0, 1.0), (b, 0.0, 1.0)], margin=1.0)["status"] == "ambiguous"
    same = assigned(spark, (0.0, 1.0), [(a, 0.0, 0.5), (a, 0.5, 1.0)], tolerance=0.5)
    assert same["status"] == "assigned" and same["top_ratio"] <= 1
    assert assigned(spark, (0.0, 1.0), [(a, 0.0, 1.0), (b, 0.95, 1.0)])["speaker_label"] == a
    assert assigned(spark, (0.0, 1.0), [(a, 0.0, 0.2), (b, 0.2, 0.4)], least=0.8, margin=1.0)["status"] == "unassigned"
    assert assigned(spark, (0.0, 1.0), [(a, 0.0, 1.0), (b, 5.0, 6.0), (c, 5.2, 5.8)])["overlapping"] is False
    assert assigned(spark, (1.0, 1.0), [(a, 0.0, 2.0)])["status"] == "unassigned"


def test_dedup_and_replace(spark):
    shape = "row_ordinal int, brand string, catalog_version string, sku string, list_price double, source_page int"
    rows = spark.createDataFrame([(1, "A", "1", "X", 5.0, 8), (2, "A", "1", "X", 5.0, 7), (3, "A", "1", None, 5.0, 9), (4, "A", "1", None, 5.0, 3), (5, "A", "1", "X", 999.0, 7)], shape)
    assert sorted(r["row_ordinal"] for r in catalog.dedup(rows).collect()) == [2, 4, 5]
    old = spark.createDataFrame([("A", "1", 1), ("A", None, 2), ("B", "1", 3)], "brand string, v string, x int")
    new = spark.createDataFrame([("A", "", 9)], "brand string, v string, x int")
    assert sorted(r["x"] for r in catalog.replace_by_key(old, new, ("brand", "v")).collect()) == [1, 3, 9]
    assert sorted(r["x"] for r in catalog.replace_by_key(old, new.limit(0), ("brand", "v"), run=new).collect()) == [1, 3]


def chunked(text):
    """Chunks by plain Python, from the rules: headers cut, long bodies are packed by sentences."""
    lines = [x.strip() for x in re.split(r"\r\n|\r|\n", text)]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    text = re.sub(rf"([.!?;:])([^\S\n]+)({contracts.INLINE})", r"\1\n\3", text)
    marks = list(re.finditer(rf"(?m)^{contracts.HEADER}", text))
    parts = [(None, text)] if not marks else [(None, text[: marks[0].start()].strip())] + [(m.group().strip(), text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(marks, marks[1:] + [None])]
    out = []
    for head, body in parts if not marks else [p for p in parts if p[1]]:
        pieces, now = [body], ""
        if len(body) > contracts.MAX_CHUNK:
            pieces = []
            for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", body):
                if now and len(f"{now} {s}") > contracts.MAX_CHUNK:
                    pieces.append(now)
                    now = s
                else:
                    now = f"{now} {s}".strip() if now else s
            pieces += [now] if now else []
        out += [(head, p.strip()) for p in pieces]
    return [(i, h, t) for i, (h, t) in enumerate(out) if t]


def test_chunks(spark):
    texts = ["1. First clause.\n2. Second one.", "Section 1: Scope\nbody text", "ARTICLE I\nThe parties", "", "The transfers end. ARTICLE 2. Payment is due.", "This is one sentence here. " * 100, "TITLE\n\n1. \n2.1) Text. A. Sub point", "x" * 3000]
    from siltstone.sources.tables import view

    texts += [r["text"] for r in view(spark, "/root/testdata/sf0.001", "contracts").limit(120).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in contracts.chunks(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["heading"], r["text"]))
    for i, text in enumerate(texts):
        assert got.get(i, []) == chunked(text), text[:200]


def test_transitions(spark):
    pairs = [(a, b) for a in orchestration.TRANSITIONS for b in orchestration.TRANSITIONS]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", orchestration.legal(F.col("a"), F.col("b")).alias("ok"))
    assert {(r["a"], r["b"]) for r in df.collect() if r["ok"]} == {(a, b) for a, after in orchestration.TRANSITIONS.items() for b in after}


def test_versioned_store(spark, tmp_path):
    held = store.VersionedStore(spark, f"file://{tmp_path}/t")
    assert held.version() == 0 and held.read() is None
    assert held.commit(spark.range(3), 0) and held.read().count() == 3
    assert not held.commit(spark.range(9), 0)
    assert held.commit(spark.range(5), 1) and held.read().count() == 5 and held.read(1).count() == 3


def test_racing_commits_keep_the_winner(spark, tmp_path, monkeypatch):
    """Two writers build on one version: the first to claim it wins, the other changes nothing that can be read."""
    path = f"file://{tmp_path}/r"
    held, other = store.VersionedStore(spark, path), store.VersionedStore(spark, path)
    assert held.commit(spark.range(2), 0)
    claim = store.VersionedStore._claim

    def late(self, version, name):
        if self is other:
            monkeypatch.setattr(store.VersionedStore, "_claim", claim)
            assert held.commit(spark.range(7), 1)  # between the other's write and its claim
        return claim(self, version, name)

    monkeypatch.setattr(store.VersionedStore, "_claim", late)
    assert not other.commit(spark.range(99), 1)
    assert held.version() == 2 and held.read().count() == 7 and held.read(1).count() == 2
    assert sum(1 for p in (tmp_path / "r").iterdir() if p.name.startswith("data-") and p.is_dir()) == 2


def test_keyed_writes_take_rows_of_one_key_in_turn(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 2, 4)], "k string, x int, revision int")
    batch = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("c", 7, 3), ("c", 7, 4), ("c", 8, 5), (None, 1, 6)], "k string, x int, at int")
    got = sorted((r["k"] or "", r["outcome"]) for r in store.insert_if_absent(stored, batch, "k", ("x",), "at").collect())
    assert got == [("", "inserted"), ("a", "conflict"), ("a", "unchanged"), ("c", "conflict"), ("c", "inserted"), ("c", "unchanged")]
    after = [(r["k"], r["x"], r["revision"]) for r in store.upsert(stored, batch.filter("k IS NOT NULL"), "k", "at").collect()]
    assert sorted(after) == [("a", 1, 1), ("b", 2, 4), ("c", 7, 1)]
    updates = spark.createDataFrame([("a", 9, None, 1), ("b", 2, 4, 2), ("b", 3, 4, 3), ("b", 5, 4, 4), ("z", 1, 1, 5), ("a", 9, 2, 6)], "k string, x int, expected_revision int, at int")
    rows = [(r["k"], r["outcome"], r["revision"]) for r in store.update(stored, updates, "k", ("x",), "at").collect()]
    assert sorted(rows, key=str) == sorted([("a", "revision_conflict", 1), ("b", "unchanged", 4), ("b", "updated", 5), ("b", "revision_conflict", 5), ("z", "missing", None), ("a", "revision_conflict", 1)], key=str)


def test_lookups(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    keys = spark.createDataFrame([("b",), ("q",), ("b",)], "k string")
    assert sorted((r["k"], r["x"] or 0, r["found"], r["error"] or "") for r in store.get(stored, keys, "k").collect()) == [("b", 2, True, ""), ("b", 2, True, ""), ("q", 0, False, "not_found")]
    assert [tuple(r) for r in store.find(stored, "k", "a").collect()] == [("a", 1)] and store.find(stored, "k", "zz").count() == 0


def test_point_lookup_reaches_the_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS x").write.parquet(f"{tmp_path}/t")
    plan = store.find(spark.read.parquet(f"{tmp_path}/t"), "id", 5)._jdf.queryExecution().toString()
    assert "EqualTo(id,5)" in plan


def test_blanks_and_whole_matches(spark):
    from siltstone.operators import validation

    df = spark.createDataFrame([("\t",), (" \n",), ("x",), (None,), ("",), ("x\n",)], "c string").select(validation.blank("c").alias("b"), validation.is_("c", validation.SAFE_ID).alias("i"))
    assert [(r["b"], r["i"]) for r in df.collect()] == [(True, False), (True, False), (False, True), (True, False), (True, False), (False, False)]


def test_legal_status_changes(spark):
    """The allowed changes, one by one."""
    want = {("received", "validated"), ("received", "rejected"), ("received", "failed"), ("validated", "transcribed"), ("validated", "failed"), ("transcribed", "diarized"), ("transcribed", "failed"), ("diarized", "roles_assigned"), ("diarized", "failed"), ("roles_assigned", "evaluated"), ("roles_assigned", "failed")}
    names = ("received", "validated", "transcribed", "diarized", "roles_assigned", "evaluated", "rejected", "failed", "unknown")
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").filter(orchestration.legal(F.col("a"), F.col("b")))
    assert {tuple(r) for r in df.collect()} == want


def test_score_sums_do_not_depend_on_order(spark):
    rows = [(1, float(v)) for v in [1e8, 0.1, -1e8, 0.2, 0.3] * 50]
    sums = {spark.createDataFrame(rows[::d], "k int, x double").repartition(n).transform(lambda df: exact.exact_sums(df, ["k"], {"s": F.col("x")})).first()["s"] for d in (1, -1) for n in (1, 3, 7)}
    assert sums == {math.fsum(v for _, v in rows)}
