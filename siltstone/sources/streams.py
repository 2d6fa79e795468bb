"""Files that don't fit in a row: recordings of any length hashed block by block, documents page by page.

Both are Python data sources over Arrow's file systems (local, HDFS, object stores by their URI). A task holds a block
of a recording, or a page of a document, never a whole file.
"""

from __future__ import annotations

import hashlib
import importlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes read at a time, pages of a partition, and small files of one, which hold no more than a block between them.
BLOCK, PAGES, FILES = 4 << 20, 64, 256
#: Names of the codecs of uncompressed recordings by format tag and bits of a sample.
CODECS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (1, 24): "pcm_s24le", (1, 32): "pcm_s32le", (3, 32): "pcm_f32le", (3, 64): "pcm_f64le", (6, 8): "pcm_alaw", (7, 8): "pcm_mulaw"}
EXTENSIBLE, UNKNOWN = 0xFFFE, 0xFFFFFFFF


def listed(path: str) -> list[tuple[str, str, int, float]]:
    """(URI of the file system and folder, path in it, bytes, seconds of its last change) of all files under a path, in order."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    held = system.get_file_info(inner)
    found = [held] if held.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    own = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((path, f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in own)


def blocks(root: str, path: str, size: int = BLOCK) -> Iterator[bytes]:
    """A file's bytes, a block at a time."""
    from pyarrow import fs

    with fs.FileSystem.from_uri(root)[0].open_input_stream(path) as stream:
        while data := stream.read(size):
            yield data


class WaveHeader:
    """What the header of a RIFF, RF64 or BW64 recording says, from its bytes in order and in pieces of any size.

    Chunks are taken as they come: the format and the sizes of large files are kept, others are skipped, and the samples' chunk
    ends the header. Samples that the file's end cuts short count as far as they go.
    """

    def __init__(self):
        self.held, self.skip, self.at, self.container = b"", 0, 0, None
        self.done = self.bad = False
        self.rate = self.channels = self.bits = self.tag = self.byte_rate = self.samples_at = self.samples = self.long = None

    def feed(self, data: bytes) -> None:
        if self.done or self.bad:
            return
        if self.skip:
            gone = min(self.skip, len(data))
            self.skip, data = self.skip - gone, data[gone:]
            self.at += gone
        self.held += data
        while not (self.done or self.bad) and self.take():
            pass

    def take(self) -> bool:
        """Take a chunk from what is held; false if more must come."""
        if self.container is None:
            if len(self.held) < 12:
                return False
            kind, form = self.held[:4], self.held[8:12]
            self.bad = kind not in (b"RIFF", b"RF64", b"BW64") or form != b"WAVE"
            self.container = "wav"
            return self.drop(12)
        if len(self.held) < 8:
            return False
        name, size = struct.unpack("<4sI", self.held[:8])
        if name == b"data":
            self.samples_at, self.done = self.at + 8, True
            self.samples = self.long if size == UNKNOWN else size
            return False
        if name in (b"fmt ", b"ds64"):
            if len(self.held) < 8 + size and size <= 1024:
                return False
            body = self.held[8 : 8 + size]
            if name == b"ds64" and len(body) >= 16:
                self.long = struct.unpack("<Q", body[8:16])[0]
            elif name == b"fmt " and len(body) >= 16:
                self.tag, self.channels, self.rate, self.byte_rate, _, self.bits = struct.unpack("<HHIIHH", body[:16])
                if self.tag == EXTENSIBLE and len(body) >= 26:
                    self.tag = struct.unpack("<H", body[24:26])[0]
        return self.drop(8 + size + size % 2)

    def drop(self, n: int) -> bool:
        gone = min(n, len(self.held))
        self.held, self.at, self.skip = self.held[gone:], self.at + gone, n - gone
        return bool(self.held)

    def told(self, size: int) -> tuple[str | None, int | None, int | None, str | None, float | None]:
        """codec, sample rate, channels, container and seconds of a file of this many bytes; nulls where it says none."""
        if self.bad or self.container is None:
            return (None,) * 5
        seconds = None
        if self.done and self.byte_rate:
            rest = max(size - self.samples_at, 0)
            seconds = (rest if self.samples is None else min(self.samples, rest)) / self.byte_rate
        return CODECS.get((self.tag, self.bits)), self.rate, self.channels, self.container, seconds


@dataclass
class FilePart(InputPartition):
    root: str
    path: str
    size: int
    modified: float
    first: int = 0
    last: int | None = None


@dataclass
class FileParts(InputPartition):
    each: list[FilePart]


class RecordingReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(*f) for f in listed(self.path)]

    def read(self, part: FilePart) -> Iterator[tuple]:
        digest, header, size = hashlib.sha256(), WaveHeader(), 0
        for data in blocks(part.root, part.path):
            digest.update(data)
            header.feed(data)
            size += len(data)
        yield part.path, size, int(part.modified * 1000), digest.hexdigest(), *header.told(size)


class Recordings(DataSource):
    """path, length, modified (milliseconds), content_hash, codec, sample_rate, channels, container, duration: a row a file."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_recordings"

    def schema(self) -> str:
        return "path string, length long, modified long, content_hash string, codec string, sample_rate int, channels int, container string, duration double"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options["path"])


class FormFeeds:
    """A decoder of plain texts whose pages end with form feeds: pages from first up to last, by what each reads of the file."""

    def count(self, stream: Iterator[bytes]) -> int:
        n, rest = 0, False
        for data in stream:
            n += data.count(b"\f")
            rest = not data.endswith(b"\f")
        return n + rest

    def pages(self, stream: Iterator[bytes], first: int, last: int) -> Iterator[tuple[int, str]]:
        page, held = 0, []
        for data in stream:
            parts = data.split(b"\f")
            for k, part in enumerate(parts):
                if first <= page < last:
                    held.append(part)
                if k + 1 < len(parts):
                    if first <= page < last:
                        yield page, b"".join(held).decode("utf-8", "replace")
                    held, page = [], page + 1
                    if page >= last:
                        return
        if first <= page < last and any(held):
            yield page, b"".join(held).decode("utf-8", "replace")


def decoder(name: str | None):
    """A page decoder by "module:class"; texts with form feeds if there's none. It has count(blocks) and pages(blocks, first, last)."""
    if not name:
        return FormFeeds()
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)()


class PageReader(DataSourceReader):
    def __init__(self, path: str, kind: str | None, pages: int):
        self.path, self.kind, self.pages = path, kind, pages

    def partitions(self) -> list[FileParts]:
        """A range of pages each. Only files longer than a block are counted here; others share partitions, whole."""
        out, small, size = [], [], 0
        for f in listed(self.path):
            if f[2] > BLOCK:
                total = decoder(self.kind).count(blocks(f[0], f[1]))
                out += [FileParts([FilePart(*f, first, min(first + self.pages, total))]) for first in range(0, total, self.pages)]
                continue
            if small and (size + f[2] > BLOCK or len(small) == FILES):
                out.append(FileParts(small))
                small, size = [], 0
            small.append(FilePart(*f))
            size += f[2]
        return [*out, FileParts(small)] if small else out

    def read(self, held: FileParts) -> Iterator[tuple]:
        for part in held.each:
            yield from self.paged(part)

    def paged(self, part: FilePart) -> Iterator[tuple]:
        last = part.last if part.last is not None else 1 << 62
        for page, text in decoder(self.kind).pages(blocks(part.root, part.path), part.first, last):
            yield part.path, page, text


class Pages(DataSource):
    """path, page_number (from 0), text: a row a page. Options: decoder (see ``decoder``), pages (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_pages"

    def schema(self) -> str:
        return "path string, page_number int, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], self.options.get("decoder"), int(self.options.get("pages", PAGES)))
