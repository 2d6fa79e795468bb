"""Packing documents into fixed-length training sequences by the sum-of-squares rule.

Each task packs the documents of its own partition, in the order in which they arrive, so texts aren't shuffled and a
lost task is simply run again. A document's ids are cut into full windows and one remainder; a full window is a
sequence of its own. A remainder of s ids goes to the fill level h (0: a new window) that makes the sum of squared
counts of partly filled windows smallest. The counts are a level array of ``window`` entries; for each level a stack
holds the open windows.

Windows that are still open when a partition ends are carried on: their remainders, with their ids, are written apart,
dealt to groups of about ``CARRIED`` remainders, and placed by the same rule again, so that small partitions pack as
well as large ones. What is open after that is a small share of a group; there the emptiest windows are cut up to fill
the fullest, and what is left of the last one is laid out as sequences whose lengths are powers of two, which need no
padding. So padding is nil however the rows are dealt out. A task holds at most ``OPEN`` open windows; beyond that the
emptiest ones are carried on early.

Ids are what the tokenizer file gives for the plain text, special tokens in it included.

Defined results: a null text counts as empty, and an empty document is its end-of-document id alone; repeated rows
and ties are packed one by one, like any others; a text of any length is tokenized whole; an empty table gives no
rows; other columns of the input are ignored, whatever their names; a null doc_id is carried through.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import cut

#: Remainders of a group that carried windows are packed in, and open windows that a task holds.
CARRIED, OPEN = 50_000, 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Fixed value: how the vocabulary's public pre-tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to their ids (unsigned 32-bit) by the tokenizer file at path, without special tokens.

    A text of ASCII and Latin letters goes through a faster engine built from the very same vocabulary file, which
    gives the same ids (tests compare them); any other text goes through the tokenizer file itself, and so does one that
    has a token of the file's added ones in it.
    """
    import os

    import regex
    import tiktoken
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters = _byte_letters()
    special = {x["content"] for x in model.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    odd = regex.compile("|".join(["[^\\t\\n\\r\\x20-\\x7EÀ-ÖØ-öø-ſ]", *map(regex.escape, sorted(special))])).search

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(own.encode(t, add_special_tokens=False).ids if odd(t) else fast.encode_ordinary(t), np.uint32) for t in texts]

    return encode


class SumOfSquares:
    """Open windows by fill level, placed by the sum-of-squares rule."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: windows, each a list of pieces

    def place(self, size: int) -> int:
        """The level to put size ids on (0: a new window); ties go to the fullest level."""
        n, room = self.count, self.window - size
        after = 2 * n[size : self.window + 1] + 1  # the level it would reach
        after[room] = 0  # a full window isn't counted
        before = 1 - 2 * n[: room + 1]
        before[0] = 0
        change = np.where((n[: room + 1] > 0) | (np.arange(room + 1) == 0), after + before, np.iinfo(np.int64).max)
        return room - int(np.argmin(change[::-1]))

    def put(self, piece: list) -> list | None:
        """Place a piece [.., length last]; the window's pieces if that filled it."""
        size = piece[-1]
        level = self.place(size)
        held = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        held.append(piece)
        if level + size == self.window:
            return held
        self.open[level + size].append(held)
        self.count[level + size] += 1
        return None

    def emptiest(self, most: int) -> Iterator[list]:
        """Take out pieces of the emptiest windows until at most most windows are open."""
        spare = int(self.count[: self.window].sum()) - most
        for level in range(1, self.window):
            while spare > 0 and self.open[level]:
                spare -= 1
                self.count[level] -= 1
                yield from self.open[level].pop()

    def rest(self) -> Iterator[list]:
        """Close all windows: the emptiest fill up the fullest; the last one is laid out in powers of two."""
        left = [(level, held) for level in range(self.window - 1, 0, -1) for held in self.open[level]]
        lo, hi = 0, len(left) - 1
        spare: list[list] = []  # pieces of windows that are cut up
        while lo <= hi:
            level, held = left[lo]
            lo += 1
            need = self.window - level
            while need:
                if not spare:
                    if lo > hi:
                        break
                    spare = list(left[hi][1])
                    hi -= 1
                need -= _move(spare, held, need)
            if need:
                spare = held
                break
            yield held
        total = sum(p[-1] for p in spare)
        for bit in reversed(range(total.bit_length())):
            need, held = (total >> bit & 1) << bit, []
            while need:
                need -= _move(spare, held, need)
            if held:
                yield held


def _move(spare: list[list], held: list[list], need: int) -> int:
    """Move up to need ids of the last spare piece to a window; how many."""
    doc, ids, start, size = spare.pop()
    take = min(size, need)
    held.append([doc, ids[:take], start, take])
    if take < size:
        spare.append([doc, ids[take:], start + take, size - take])
    return take


class Sequences:
    """Rows of SCHEMA for windows that are done, numbered from first on."""

    def __init__(self, first: int):
        self.number, self.rows = first, []

    def add(self, pieces: list) -> None:
        offset = 0
        for (doc, total), ids, start, size in pieces:
            self.rows.append((doc, start, size, zlib.crc32(ids.astype("<u4").tobytes()), total, self.number, offset))
            offset += size
        self.number += 1

    def flush(self) -> list[pa.Array]:
        out = [pa.array(c, pa.int64()) for c in zip(*self.rows)] if self.rows else [pa.array([], pa.int64())] * 7
        self.rows = []
        return out


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _placing(tokenizer_path: str, window: int, end_id: int):
    """Texts to rows of SCHEMA, and the remainders of open windows: these with their ids, without a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer_path), SumOfSquares(window)
        context = TaskContext.get()
        done = Sequences((context.partitionId() if context else 0) << 40)

        def batch_of(open_: list[list]) -> pa.RecordBatch:
            columns = done.flush()
            n, m = len(columns[0]), len(open_)
            own = [[doc for (doc, _), *_ in open_], [p[2] for p in open_], [p[3] for p in open_], [None] * m, [total for (_, total), *_ in open_], [None] * m, [None] * m]
            both = [pa.concat_arrays([a, pa.array(b, pa.int64())]) for a, b in zip(columns, own)]
            ids = pa.array([None] * n + [p[1].astype("<u4").tobytes() for p in open_], pa.binary())
            return pa.RecordBatch.from_arrays([*both, ids], names=[*NAMES, "ids"])

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids_of), 256):
                part = texts.slice(at, 256).to_pylist()
                for doc, ids in zip(ids_of[at : at + 256], encode([t or "" for t in part])):
                    ids = np.append(ids, np.uint32(end_id))
                    who = (doc, len(ids))
                    full = len(ids) - len(ids) % window
                    for start in range(0, full, window):
                        done.add([[who, ids[start : start + window], start, window]])
                    if full < len(ids) and (held := bins.put([who, ids[full:].copy(), full, len(ids) - full])):
                        done.add(held)
            yield batch_of(list(bins.emptiest(OPEN)))
        left = list(bins.emptiest(0))
        for at in range(0, len(left), 4096):
            yield batch_of(left[at : at + 4096])

    return run


def _closing(window: int):
    """Remainders of open windows to rows of SCHEMA: placed again by the same rule, then cut where windows stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, context = SumOfSquares(window), TaskContext.get()
        done = Sequences((1 << 22 | (context.partitionId() if context else 0)) << 40)
        for batch in batches:
            doc, start, size, total, ids = (batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids"))
            for i in range(batch.num_rows):
                if held := bins.put([(doc[i], total[i]), np.frombuffer(ids[i], "<u4"), start[i], size[i]]):
                    done.add(held)
            yield pa.RecordBatch.from_arrays(done.flush(), names=NAMES)
        for held in bins.rest():
            done.add(held)
        yield pa.RecordBatch.from_arrays(done.flush(), names=NAMES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece (SCHEMA): ids [start, start + length) of doc_id's doc_tokens ids lie in sequence_id from offset on."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = cut(texts.mapInArrow(_placing(tokenizer_path, window, end_id), f"{SCHEMA}, ids binary"), "packed")
    open_ = placed.filter("ids IS NOT NULL")
    groups = max(1, -(-open_.count() // CARRIED))
    closed = open_.select("doc_id", "start", "length", "doc_tokens", "ids").repartition(groups).mapInArrow(_closing(window), SCHEMA)
    return placed.filter("ids IS NULL").drop("ids").unionByName(closed)
