"""Hard negatives, the filter audit and the n-gram join against brute force, parameters off the usual, and edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import dual_tree, filter_audit, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, root string, token long, mask int, part string"
EXTRA = ("s", 1, "n", "r", 2, 3, "p")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, *EXTRA) for i, t, lang in rows], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Filter audit


def fails(row, rows):
    i, text, _ = row
    text, ws = text or "", words(text)
    return {
        "A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
    }


def audited(rows, labels):
    good, toxic = ({i for i, *ls in labels if i is not None and ls[k] == 1} for k in (0, 1))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(r, fails(r, rows)) for r in rows if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = order[:step]
                here = [r for r, x in own if x[f] and not any(x[b] for b in before)]
                shapley[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    sum(not any(x[b] for b in before) and not x[f] for _, x in own), len(here), sum(x[f] and any(x[b] for b in before) for _, x in own),
                    sum(x[f] and sum(x.values()) == 1 for _, x in own), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_on_nulls_repeats_and_ties(spark):
    rng = random.Random(3)
    some = [" ".join(f"{rng.choice('abXY')}{rng.randrange(60)}" for _ in range(rng.choice([30, 99, 100, 140]))) + rng.choice(["", " #", " é漢🙂"]) for _ in range(12)]
    rows = [(i, rng.choice([*some, None, "", "ABC"]), rng.choice(["en", "de", None, ""])) for i in range(40)] + [(None, some[0], "en"), (None, some[0], "en"), (5, some[1], "de"), (5, some[1], "de"), (None, None, None)]
    labels = [(1, 1, 0), (1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, 1), (3, 1, 0), (99, 1, 1), (5, 1, None)]
    found = filter_audit.audit(docs(spark, rows), spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, part string"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == audited(rows, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), empty).count() == 0
    alone = filter_audit.audit(docs(spark, [(1, "x " * 300_000, "en")]), empty).collect()
    assert len(alone) == 600 and {r["unique_fails"] for r in alone} == {0, 1}  # B alone


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=32, max_size=32))
def test_sums_are_inverted_exactly(cells):
    sums = [sum(n * (-1) ** (m & s).bit_count() for m, n in enumerate(cells)) for s in range(32)]
    back = [sum(x * (-1) ** (m & s).bit_count() for s, x in enumerate(sums)) for m in range(32)]
    assert [b // 32 for b in back] == cells and not any(b % 32 for b in back)


def test_spectrum_and_inverse_in_spark(spark):
    counts = spark.createDataFrame([("a", False, False, m, m * m + 1) for m in range(32)], "part string, good boolean, toxic boolean, mask int, n long")
    back = filter_audit.spectrum(counts).select(filter_audit.inverted(F.col("sums")).alias("cells")).first()["cells"]
    assert back == [m * m + 1 for m in range(32)]


# N-gram join


def joined(rows, percent=90, n=3):
    sets = []
    for _, text, _ in rows:
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = defaultdict(lambda: None)
    for k, (i, _, _) in enumerate(rows):
        if i is not None and (least[top(k)] is None or i < least[top(k)]):
            least[top(k)] = i
    return Counter((i, len(sets[k]), least[top(k)] if sets[k] else i) for k, (i, _, _) in enumerate(rows))


def edited(rng, ws, times):
    ws = list(ws)
    for _ in range(times):
        ws[rng.randrange(len(ws))] = f"new{rng.randrange(10**6)}"
    return " ".join(ws)


def corpus(seed, n=150):
    """Chains of edits, a group of near copies around one text, a passage that all share, and texts around the threshold."""
    rng = random.Random(seed)
    plain = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    base, passage, out = plain(200), plain(60), []
    for i in range(n):
        kind = i % 5
        if kind == 0:
            text = edited(rng, base, rng.randrange(6))
        elif kind == 1:
            text = " ".join(plain(40) + passage + plain(40))
        elif kind == 2 and out:
            text = edited(rng, words(rng.choice(out)[1]) or ["a"], rng.randrange(1, 5))
        elif kind == 3:
            text = " ".join(plain(rng.randrange(1, 6)))
        else:
            text = " ".join(passage + plain(rng.randrange(0, 12)))
        out.append((i, text, "en"))
    return out


@pytest.mark.parametrize(("percent", "n", "short", "size"), [(90, 3, 32, 400_000), (90, 3, 2, 3000), (70, 2, 4, 2000), (50, 5, 1, 1500)])
def test_join_equals_all_pairs(spark, monkeypatch, percent, n, short, size):
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK_SIZE", size)
    rows = corpus(percent + n)
    assert Counter(map(tuple, ngram_join.classes(docs(spark, rows), percent, n).collect())) == joined(rows, percent, n)


def test_join_on_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"word{i % 7919} is {i}" for i in range(40_000))
    rows = [(1, "A b C d", "x"), (2, "a  B\tc\nd", None), (3, None, None), (4, "", "x"), (None, "a b c d", "x"), (None, None, None), (5, "x", "x"), (6, "X", "x"), (5, "a b c d", "x"), (5, "x", "x"), (7, " \n ", "x")]
    rows += [(8, long, "x"), (9, long + " more", "x"), (10, "É é", "x"), (11, "é é", "x"), (None, "only nulls here", "x"), (None, "only nulls here", "x"), (12, "a b c", "x"), (13, "z " * 3, "x"), (14, "z " * 50_000, "x")]
    found = ngram_join.classes(docs(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, found.collect())) == joined(rows)
    assert ngram_join.classes(docs(spark, [])).count() == 0


def test_answers_are_the_overlaps():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 500, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(20, 60)], rng.integers(0, 500, rng.integers(1, 30)).astype(np.uint64)])) for _ in range(40)]
    for i, found in ngram_join.answers(sets, ngram_join.Lists(sets)):
        assert found.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


# Hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, cell int, shard int, slot int, x int"


def mined(rows, every=100, k_pos=5, k_neg=5):
    import math

    whole = lambda x: [math.floor(v * 256) for v in x]
    held = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(whole(x)), tuple(x)) for i, x, y in rows if i is not None and x is not None and y is not None and all(v is not None and math.isfinite(v) for v in x)}
    out = Counter()
    for i, y, x, _ in held:
        if i % every:
            continue
        met = sorted((-sum(a * b for a, b in zip(x, v)), j, z) for j, z, v, _ in held if j != i and len(v) == len(x))
        for p, j, _ in [m for m in met if m[2] == y][:k_pos]:
            fit = [(s, m) for s, m, z in met if z != y and 80 * -p <= 100 * -s <= 100 * -p][:k_neg]
            out.update((i, j, k + 1, m, -p, -s) for k, (s, m) in enumerate(fit))
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)


@pytest.mark.parametrize("shard", [1 << 14, 64])
def test_negatives_equal_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(dual_tree, "SHARD_ROWS", shard)
    monkeypatch.setattr(dual_tree, "BLOCK", 8 if shard < 100 else 4096)
    monkeypatch.setattr(dual_tree, "LEAF", 16)
    rng = np.random.default_rng(shard)
    centres = rng.normal(0, 1, (8, 6))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.15, 6)).round(2).tolist(), int(rng.integers(0, 3)) if i % 3 else 1) for i in range(600)]
    found = dual_tree.mine(vectors(spark, rows), every=10)
    assert Counter(map(tuple, found.collect())) == mined(rows, 10)


def test_negatives_on_nulls_ties_and_magnitudes(spark):
    nan, inf, same = float("nan"), float("inf"), [1.0, 2.0, 3.0]
    rows = [(100 * k, same, k % 2) for k in range(12)] + [(k, same, k % 3) for k in range(1, 60)] + [(k, same, k % 3) for k in range(1, 9)]
    rows += [(None, same, 1), (61, None, 1), (62, same, None), (63, [nan, 1.0, 1.0], 1), (64, [None, 1.0, 1.0], 1), (65, [inf, 1.0, 1.0], 1), (66, [0.0, 0.0, 0.0], 1), (200, [-1.0, -2.0, -3.0], 0), (-7, same, 9), (-100, [0.5, 0.5, 0.5], 0)]
    rows += [(300, [1.0], 1), (67, [2.0], 1), (68, [2.0], 2), (69, [1.9], 2), (400, [], 1), (70, [], 1), (71, [], 2), (500, [1e-30, 2.0], 1), (72, [-1e-30, 2.0], 1), (73, [0.0, 2.0], 2), (600, [3e4, 1e4], 2), (74, [3e4, 2e4], 2), (75, [3e4, 1e4], 1), (76, [2.5e4, 1.0], 1)]
    found = dual_tree.mine(vectors(spark, rows))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == mined(rows)
    assert dual_tree.mine(vectors(spark, [])).count() == 0
    assert dual_tree.mine(vectors(spark, [(100, same, 1)])).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40, 3.0, -1.0]]), np.array([[2.0**20, 1.0, 1.0], [2.0**20, 0.0, 1.0]])
    assert dual_tree.inner(a, b).tolist() == [[2**60 + 2, 2**60 - 1]]
    assert dual_tree.inner(np.array([[1e300]]), np.array([[1e300], [-1e300]])).tolist() == [[dual_tree.MOST, dual_tree.LEAST]]
