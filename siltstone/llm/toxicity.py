"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

Every word of a text, with white space around it, is a window, and so is every word that gains anything together with
its neighbours (``BESIDE`` on either side). Both dictionaries compress a window; the bytes that the toxic one saves over
the ordinary one are its gain. A document is told by its greatest gain and by how many of its windows gain at least each
of ``THRESHOLDS`` bytes, in number and as a share of its words, for words alone and for words in context; a logistic
calibration turns that into a score.

Windows are short, so three things keep their compressed lengths apart: both dictionaries are raw content without
entropy tables and start with the same ordinary text, to which the toxic one adds what was trained on toxic windows;
every window is followed by the same carrier, which both dictionaries end with, as the compressor does not search the
last bytes of its input; and the frame holds neither its size nor a checksum.

Training takes a bounded sample: up to ``SAMPLE`` labelled documents of each class, by a hash of the id, of at most
``SAMPLE_CHARS`` characters, of which documents with the same opening words count once. A toxic document is mostly
ordinary text, and a dictionary of all of it tells little (README has figures), so the toxic dictionary is trained on
those windows of toxic documents whose words stand out against ordinary ones, and ends with the most frequent of these
windows. The calibration uses scores out of fold. Without documents of both classes every score is 0.

Scoring is one pass without a shuffle. A task keeps the gains of up to ``CACHE`` words.

Defined results: null and empty texts have no windows and score what the calibration gives those; a text of any
length is read whole, and what stands between white space counts as words of ``LONGEST`` characters, so that a text
without white space has windows like any other; repeated rows score alike; an id that is labelled twice counts as toxic
if one label says so; a null doc_id is carried through, not held out and never learnt from; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import held_out, labelled

SAMPLE, SAMPLE_CHARS = 3000, 50_000
CACHE = 400_000
ORDINARY_BYTES, TOXIC_BYTES = 65536, 8192
THRESHOLDS = (2, 3, 4, 6)
#: Words beside one that gains, and characters of a word.
BESIDE, LONGEST = 1, 64
#: How far (in standard errors) a word's share of toxic documents must be above its share of ordinary ones.
STANDS_OUT = 4.0
#: Folds of the training sample, and how much more a toxic document counts in the calibration than an ordinary one.
FOLDS, TOXIC_WEIGHT = 5, 2.0
LEVEL = 3
CARRIER = b"0123456789_=+/ABCDEFGHIJ"
EDGES = ".,;:!?\"'()[]"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_windows long, max_gain long"


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: list[float]


class Gains(dict):
    """Bytes that the toxic dictionary saves on windows; those of single words are kept."""

    def __init__(self, model: Model):
        super().__init__()
        options = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)

        def sizes(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=options)
            return zstandard.ZstdCompressor(dict_data=held, compression_params=options).compress

        self.plain, self.foul = sizes(model.ordinary + CARRIER), sizes(model.ordinary + model.toxic + CARRIER)

    def __missing__(self, word: str) -> int:
        window = b" " + word.strip(EDGES).encode("utf-8", "surrogatepass") + b" " + CARRIER
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = len(self.plain(window)) - len(self.foul(window))
        return found

    def of(self, words: list[str]) -> tuple[Counter, Counter]:
        """How many words have each gain, alone, and in context if they gain anything."""
        alone = [self[w] for w in words]
        around = [words[max(0, i - BESIDE) : i + BESIDE + 1] for i, g in enumerate(alone) if g >= THRESHOLDS[0]]
        windows = (f" {' '.join(ws)} ".encode("utf-8", "surrogatepass") + CARRIER for ws in around)
        return Counter(alone), Counter(len(self.plain(w)) - len(self.foul(w)) for w in windows)


def words_of(text: str) -> list[str]:
    """A text's words in lower case, cut where they're longer than LONGEST."""
    words = text.lower().split()
    if words and max(map(len, words)) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def features(gains: Gains, text: str) -> tuple[list[float], int, int]:
    """What the calibration sees, the number of words and the greatest gain of a word."""
    words = words_of(text)
    out, found = [1.0], gains.of(words)
    for held in found:
        counts = [sum(c for g, c in held.items() if g >= t) for t in THRESHOLDS]
        out += [max(0, min(max(held, default=0), 12)) / 10, *(math.log1p(c) for c in counts), *(math.log1p(100 * c / max(1, len(words))) for c in counts)]
    return out, len(words), max(found[0], default=0)


def _dictionaries(toxic: list[str], ordinary: list[str]) -> Model | None:
    """The two dictionaries' content, from texts of either class."""
    seen = [Counter(w for t in texts for w in {x.strip(EDGES) for x in t.lower().split()}) for texts in (toxic, ordinary)]
    n, m = max(1, len(toxic)), max(1, len(ordinary))

    def stands_out(w: str) -> bool:
        a, b = seen[0][w], seen[1][w]
        error = math.sqrt((a + b + 1) / (n + m) * (1 / n + 1 / m))
        return a >= 2 and b * n < 0.1 * a * m and (a / n - b / m) > STANDS_OUT * error

    marks = {w for w in seen[0] if w and stands_out(w)}
    windows = [f" {x} ".encode("utf-8", "surrogatepass") for t in toxic for x in t.lower().split() if x.strip(EDGES) in marks]
    plain = [t[i : i + 400].lower().encode("utf-8", "surrogatepass") for t in ordinary for i in range(0, len(t), 400)]
    if not windows or not plain:
        return None
    common = Counter(f" {x.strip(EDGES)} ".encode("utf-8", "surrogatepass") for t in toxic for x in t.lower().split() if x.strip(EDGES) in marks)
    whole = b"".join(w for w, _ in sorted(common.items(), key=lambda x: (x[1], x[0])))[-TOXIC_BYTES:]
    return Model(_trained(plain, ORDINARY_BYTES, 48), _trained(windows, TOXIC_BYTES, 16) + whole, [])


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's bytes; of too few samples to train one, the distinct samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Newton's method; rows of class 1 count TOXIC_WEIGHT times."""
    w, times = np.zeros(x.shape[1]), np.where(y > 0, TOXIC_WEIGHT, 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (times * (y - p)) - ridge * w
        curve = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Dictionaries and calibration from the labelled rows that aren't held out; None without both classes."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    rows = labelled(docs, marked.groupBy("doc_id").agg(F.max("toxic").alias("label")), sample, SAMPLE_CHARS)
    ordinary, toxic = (list({" ".join(t.split()[:6]): t for y, t in rows if y == label}.values()) for label in (0, 1))
    xs, ys = [], []
    for fold in range(FOLDS):
        part = _dictionaries(*[[t for i, t in enumerate(texts) if i % FOLDS != fold] for texts in (toxic, ordinary)])
        if part is None:
            continue
        gains = Gains(part)
        for y, rest in ((1.0, toxic[fold::FOLDS]), (0.0, ordinary[fold::FOLDS])):
            xs += [features(gains, t)[0] for t in rest]
            ys += [y] * len(rest)
    whole = _dictionaries(toxic, ordinary)
    if whole is None or len(set(ys)) < 2:
        return None
    return whole._replace(weights=_logistic(np.array(xs), np.array(ys)).tolist())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """SCHEMA, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model) if model else None
        weights = np.array(model.weights) if model else None
        for batch in batches:
            texts = batch.column(2)
            if not len(texts):
                continue
            rows = []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                rows.append(features(gains, text) if gains is not None else ([], len(text.split()), 0))
            p = 1 / (1 + np.exp(-np.clip(np.array([r[0] for r in rows]) @ weights, -30, 30))) if model else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
