"""Quality rules: a chain model labels every line content or boilerplate, and the share of content decides.

The lines of a document are one sequence. A linear-chain conditional random field sees each line's make-up (length,
shares of digits, capitals, symbols and repeated words, whether the line came before, and so on); Viterbi decoding
marks the lines, and a document is kept if at least ``share`` of its words stand in content lines, unless a base rule
rejects it first.

The model is trained on a bounded sample of labelled documents (``SAMPLE`` rows of each class, by a hash of the id, of
at most ``SAMPLE_CHARS`` characters; never held-out ids). Labels are of documents, not lines, so two things make line
labels of them. Training documents are also mixed from runs of lines of a good and of a bad one, from a fixed seed, so
that labels change within a sequence, as they do in documents that are partly spoilt. And a first model, trained with
the lines of bad documents as boilerplate but for those that a good one has too, marks those of their lines that, each on
its own, are like good documents' lines; the second model, which is used, learns these as content. Sequences are cut every ``PIECE`` lines for training only. Without
labelled rows of both classes every line counts as content, so the base rules alone decide.

One pass over the documents, without a shuffle; a task holds one batch of rows at a time.

Defined results: a null text has no words, and like an empty one fails the base rules; a text of any length is read
whole; lines without a word are skipped; repeated rows are judged one by one; null doc_ids are carried through; an id
that is labelled twice counts as bad if one label says so; an empty table gives no rows; other columns of the input are
ignored, or kept as they are by ``keep``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm import chain
from siltstone.llm.common import held_out, labelled

#: Labelled documents of each class to train on, and the most characters one may have; lines of a training sequence.
SAMPLE, SAMPLE_CHARS, PIECE = 1500, 50_000, 200
#: Seed of the mixed training documents, and the most lines of a run in them.
SEED, RUN = 11, 12
SHARE = 0.5
MIN_WORDS, MAX_REPEATS = 50, 50
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"

SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
FEATURES = 14


def repeat_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    k = len(known)
    if k == n:
        return 0
    if k < 2_000_000:
        code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        code = pair[:-1] * k + ids[2:]
    order = np.argsort(code, kind="stable")
    code = code[order]
    same = code[1:] == code[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    held = np.zeros(n, bool)
    held[at] = held[at + 1] = held[at + 2] = True
    return int(held.sum())


def describe(line: bytes, words: list[bytes], again: bool) -> tuple:
    """Features of a line that has a word."""
    n, size = len(words), len(line)
    letters = line.translate(None, b"\t\x0b\x0c\r ")
    solid = len(letters)
    marks = len(letters.translate(None, b"#*$%&|<>"))
    digits = len(letters.translate(None, b"0123456789"))
    capitals = len(letters.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    cries = len(letters.translate(None, b"!?"))
    distinct = len(set(words))
    return (
        1.0,
        min(n, 100) / 100,
        float(n < 4),
        float(again),
        1 - distinct / n,
        float(n >= 8 and distinct * 2 < n),
        1 - marks / solid,
        float((solid - marks) * 10 > solid),
        1 - digits / solid,
        1 - capitals / solid,
        float((solid - capitals) * 2 > solid),
        min(1.0, 10 * (1 - cries / solid)),
        min(solid / n, 30) / 30,
        float(letters[-1:] in (b".", b"!", b"?", b":", b";")),
    )


def lines_of(text: str) -> tuple[list[tuple], list[int], int, list[bytes]]:
    """Features and word counts of the lines that have a word, the number of these that came before, and all words."""
    rows, counts, repeats, words = [], [], 0, []
    seen: set[bytes] = set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        rows.append(describe(line, own, again))
        counts.append(len(own))
        words += own
    return rows, counts, repeats, words


def mixed(good: list[str], bad: list[tuple[str, int]], rng: random.Random) -> list[tuple[str, int]]:
    """Lines of a document that takes turns between runs of good lines and of another document's lines with their marks."""
    held = [[(x, 1) for x in good], list(bad)]
    side, out = rng.randrange(2), []
    while held[0] or held[1]:
        run = rng.randint(1, RUN)
        out += held[side][:run]
        del held[side][:run]
        side = 1 - side
    return out


def sequences(documents: list[list[tuple[str, int]]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Features and marks of lines (line, mark) with a word, by pieces of PIECE lines."""
    rows, marks = [], []
    for lines in documents:
        solid = [(x, y) for x, y in lines if x.encode("utf-8", "surrogatepass").split()]
        feats = lines_of("\n".join(x for x, _ in solid))[0]
        for at in range(0, len(feats), PIECE):
            rows.append(np.array(feats[at : at + PIECE]))
            marks.append(np.array([y for _, y in solid[at : at + PIECE]]))
    return rows, marks


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """A chain model of the labelled sample without held-out ids; None if a class is missing."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().filter(~held_out())
    rows = labelled(docs, marked.groupBy("doc_id").agg(F.min("quality").alias("label")), sample, SAMPLE_CHARS)
    good, bad = ([t.split("\n") for t in dict.fromkeys(t for y, t in rows if y == label) if t.split()] for label in (1, 0))
    if not good or not bad:
        return None
    known = {x for g in good for x in g}
    marks = [[int(x in known) for x in lines] for lines in bad]
    model = None
    for steps in (40, 100):
        rng, spoilt = random.Random(SEED), [list(zip(x, y)) for x, y in zip(bad, marks)]
        both = [mixed(g, spoilt[i % len(spoilt)], rng) for i, g in enumerate(good)]
        model = chain.train(*sequences([[(x, 1) for x in g] for g in good] + spoilt + both), steps=steps)
        for lines, own in zip(bad, marks):
            solid = [i for i, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").split()]
            alone = np.array(lines_of("\n".join(lines))[0]) @ model[0]
            for i, (x, y) in zip(solid, alone):
                own[i] = int(y > x)
    return model


def judge(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, share: float = SHARE) -> DataFrame:
    """SCHEMA, one row per document."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judging(model, share, False), SCHEMA)


def keep(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, share: float = SHARE) -> DataFrame:
    """The documents kept, with all their columns."""
    ship(docs.sparkSession)
    # Names of any kind, such as those with dots, come back at the end.
    plain = docs.toDF(*[c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)])
    return plain.mapInArrow(_judging(model, share, True), plain.schema).toDF(*docs.columns)


def _judging(model, share: float, filtering: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = (model[0].tolist(), model[1].tolist()) if model else (None, None)
        table = np.array(weights) if model else None
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text")).cast(pa.string())
            out = []
            for at in range(len(texts)):
                text = texts[at].as_py() or ""
                rows, counts, repeats, words = lines_of(text)
                n = len(words)
                spaces = sum(text.count(c) for c in SPACE)
                again = repeat_words(words)
                failed = n < MIN_WORDS or 100 * again > MAX_REPEATS * n
                good = n
                if table is not None and rows:
                    labels = chain.viterbi((np.array(rows) @ table).tolist(), moves)
                    good = sum(c for c, y in zip(counts, labels) if y)
                part = good / n if n else 0.0
                out.append((n, len(text) - spaces, sum(text.count(c) for c in SYMBOLS), repeats, again, failed, not failed and part >= share, part))
            if filtering:
                yield batch.filter(pa.array([r[6] for r in out], pa.bool_()))
            elif out:
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
                columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run
