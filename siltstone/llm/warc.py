"""Web archives: write WARC records, read them back by a verified chain of record boundaries.

Writing is a plain Spark text sink, one archive per task, so the commit protocol keeps whole files only and a lost
task writes its archive again. Each record is an HTTP response in UTF-8; a page whose payload equals that of a page
with a smaller id is a ``revisit`` that holds the HTTP header alone and points to that page. Payload classes are found
on digests, summed up before anything is shuffled; only classes of two pages or more are joined with the pages, so Spark
ships them to the pages while they're small by their written size, and shuffles beyond that.

Reading takes an archive apart by byte ranges, so an archive of any size is read by many tasks, and a task holds one
record at a time:

1. Each task lists the places in its range where a record's magic starts, as candidates. A candidate's own header says
   how long it is, so where the next record must start. Candidates inside payloads look like any other. Places count
   from the archive's start, by running sums of what each range holds. Digests are taken here, so that texts aren't
   shuffled.
2. Pointer jumping inside each range finds where the chain that starts at each candidate leaves the range. Pointer
   jumping between ranges, on those places alone, then finds where the chain from the archive's start enters each range:
   with every round pointers are twice as long, so a chain through n ranges takes log2(n) rounds.
3. From its entries each range marks the candidates reached. What isn't reached, such as a magic inside a payload, is
   dropped, and so is a record that the archive's end cuts short.
4. A record with magics in its payload is put together from its pieces.

The archives themselves are read once, in one job that writes what stands between magics as a table; all else reads that
table. So it doesn't matter if Spark would split them otherwise later on, as it does when executors come or go.

Defined results: a null html is an empty payload; a null url is written as an empty target; line breaks in a url are
percent-encoded; rows that repeat the smallest page_id of their payload class are all responses; a null page_id is
larger than any other, and a class of null ids alone is all responses; an empty table writes no archive and gives no
rows; other columns of the input are ignored. A record whose payload isn't what its header says is a row with an
``error``; where a length is damaged the chain ends, and the rest of that archive isn't read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm.common import cut

MAGIC, BREAK = "WARC/1.1\r\n", "\r\n\r\n"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, error string, payload binary"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
#: Bytes of the slots by which a record with magics in its payload finds its pieces.
SLOT = 1 << 20

#: The digits of base 32 as Spark's conv writes them, and as RFC 4648 does.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hexadecimal digits are four of base 32."""
    hexadecimal = F.sha1(payload)
    quarters = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*quarters), DIGITS, BASE32)


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per page to archives under path. Equal payloads of at least least_bytes become revisits."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    held = held.withColumn("digest", digest(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    classes = held.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    held = held.join(cut(classes.filter("n > 1").select("digest", "first"), "classes"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.lit("WARC-Date: 2020-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
    )
    # The sink ends each row by a line feed, the last of the record's "\r\n\r\n".
    record = F.concat(head, http, F.when(again, "").otherwise(F.col("html")), F.lit("\r\n\r"))
    held.select(record.alias("value")).write.option("lineSep", "\n").text(path)


def header(block: Column, name: str) -> Column:
    """A header line's value; null if there's no such line."""
    return F.nullif(F.regexp_extract(block, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))


def number(c: Column) -> Column:
    """A whole number from text; null from any other."""
    return F.when(F.regexp_like(c, F.lit(r"^-?\d{1,19}$")), c.try_cast("long"))


def length(value: Column) -> Column:
    """Bytes from a record's magic to the next record, by its header (value: what follows the magic); null if that says none."""
    head = F.substring_index(value, BREAK, 1)
    own = number(header(head, "Content-Length"))
    return F.when(F.contains(value, F.lit(BREAK)) & (own >= 0), len(MAGIC) + F.octet_length(head) + own + 2 * len(BREAK))


def fields(value: Column) -> dict[str, Column]:
    """What a whole record says (value: what follows its magic), by column of SCHEMA."""
    head, both = F.substring_index(value, BREAK, 1), F.substring_index(value, BREAK, 2)
    http = F.substring(both.cast("binary"), F.octet_length(head) + len(BREAK) + 1, F.octet_length(both)).cast("string")
    # What follows the record's own length, such as junk before the next magic, isn't its payload.
    begin, end = F.octet_length(both) + len(BREAK), F.octet_length(head) + len(BREAK) + F.coalesce(number(header(head, "Content-Length")), F.lit(0)).cast("int")
    payload = F.substring(value.cast("binary"), begin + 1, F.greatest(end - begin, F.lit(0)))
    kind, said = header(head, "WARC-Type"), number(header(http, "Content-Length"))
    told = F.regexp_replace(header(head, "WARC-Payload-Digest"), "^sha1:", "")
    page = lambda name: number(F.regexp_extract(F.coalesce(header(head, name), F.lit("")), "^<urn:page:(.*)>$", 1))
    whole = told.eqNullSafe(digest(payload)) & said.eqNullSafe(F.octet_length(payload).cast("long"))
    return {
        "page_id": page("WARC-Record-ID"), "url": F.coalesce(header(head, "WARC-Target-URI"), F.lit("")), "payload_bytes": F.coalesce(said, F.lit(0).cast("long")), "payload_digest": told, "record_type": kind,
        "refers_to": page("WARC-Refers-To"), "error": F.when((kind == "response") & ~whole, "payload_differs"), "payload": payload,
    }


def pointers(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each candidate the number of that which starts where it ends; len(starts) if there's none. starts in order."""
    n = len(starts)
    to = np.searchsorted(starts, ends)
    to[(to < n) & (starts[np.minimum(to, max(n - 1, 0))] != ends)] = n
    return to


def reachable(starts: np.ndarray, ends: np.ndarray, size: int, entries: Sequence[int] = (0,)) -> np.ndarray:
    """Which candidates chains from these places reach, by pointer jumping; those that end beyond size aren't."""
    n = len(starts)
    marked = np.zeros(n + 1, bool)  # entry n: no record
    if not n:
        return marked[:n]
    marked[:n] = np.isin(starts, np.asarray(entries, np.int64))
    jump = np.append(pointers(starts, ends), n)
    while True:
        reached = jump[np.flatnonzero(marked)]
        fresh = reached[~marked[reached]]
        fresh = fresh[fresh < n]
        if not len(fresh):
            break
        marked[fresh] = True
        jump = jump[jump]
    return marked[:n] & (ends <= size)


def leaving(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each candidate the first place on its chain at which none of these candidates starts, by pointer jumping."""
    to = pointers(starts, ends)
    # The last candidate of a chain points to itself. Every candidate ends beyond its start, so there are no loops.
    last = np.where(to < len(starts), to, np.arange(len(starts)))
    while (last[last] != last).any():
        last = last[last]
    return ends[last]


RANGE = ("archive", "block")


def scanned(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """archive, block, seq, value and more of what stands between magics; block: where a task's byte range starts."""
    rows = spark.read.option("lineSep", MAGIC).option("pathGlobFilter", "part-*").text(path)
    return rows.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value", *more)


def placed(rows: DataFrame) -> DataFrame:
    """rows (archive, block, seq, bytes) with at, where each one's magic starts in its archive, and size, the archive's bytes."""
    wide = F.col("bytes") + len(MAGIC)
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy(*RANGE).agg(F.sum(wide).alias("total"))  # a row a byte range
    archive = W.partitionBy("archive")
    ranges = ranges.select(*RANGE, F.coalesce(F.sum("total").over(before(archive.orderBy("block"))), F.lit(0)).alias("begin"), (F.sum("total").over(archive) - len(MAGIC)).alias("size"))
    inside = F.coalesce(F.sum(wide).over(before(W.partitionBy(*RANGE).orderBy("seq"))), F.lit(0))
    return rows.withColumn("inside", inside).join(ranges, list(RANGE)).withColumn("at", F.col("begin") + F.col("inside") - len(MAGIC)).drop("begin", "inside")


def chained(candidates: DataFrame) -> DataFrame:
    """archive, at of the candidates (archive, block, at, end, size) on the chain from the archive's start."""

    def collapse(own: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        at, end = own.column("at").to_numpy(), own.column("end").to_numpy()
        return own.select(["archive", "block", "at"]).append_column("leave", pa.array(leaving(at, end), pa.int64()))

    def mark(own: pa.Table, entries: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        if not own.num_rows:
            return own.select(["archive", "at"])
        on = reachable(own.column("at").to_numpy(), own.column("end").to_numpy(), own.column("size")[0].as_py(), entries.column("at").to_numpy())
        return own.select(["archive", "at"]).filter(pa.array(on, pa.bool_()))

    ship(candidates.sparkSession)
    nodes = cut(candidates.select(*RANGE, "at", "end").groupBy(*RANGE).applyInArrow(collapse, "archive string, block long, at long, leave long"), "leaving")
    # Only an archive's start, and places at which another range's chain arrives, can be entered.
    arrived = nodes.select("archive", F.col("leave").alias("at")).distinct()
    nodes = nodes.join(arrived, ["archive", "at"], "left_semi").unionByName(nodes.filter("at = 0")).distinct()
    jump = cut(nodes.select("archive", "block", "at", "leave"), "entered")
    entered = jump.filter("at = 0").select("archive", "block", "at")
    known, step = 0, jump.select("archive", F.col("at").alias("from"), F.col("leave").alias("to"))
    place = jump.select("archive", "block", "at")
    while (n := entered.count()) > known:
        known = n
        further = entered.join(step, (entered["archive"] == step["archive"]) & (entered["at"] == step["from"])).select(entered["archive"], F.col("to").alias("at"))
        entered = cut(entered.unionByName(further.join(place, ["archive", "at"]).select("archive", "block", "at")).distinct(), "entered")
        on = step.select(F.col("archive").alias("a"), F.col("from").alias("f"), F.col("to").alias("t"))
        step = cut(step.join(on, (F.col("archive") == F.col("a")) & (F.col("to") == F.col("f"))).select("archive", "from", F.col("t").alias("to")), "step")
    by = lambda df: df.groupBy(*RANGE)
    return by(candidates.select(*RANGE, "at", "end", "size")).cogroup(by(entered)).applyInArrow(mark, "archive string, at long")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """SCHEMA, one row per record of the archives under path; a revisit's payload is empty. Without payloads: all but these."""
    wanted = [c for c in FIELDS if payloads or c != "payload"]
    value = F.col("value")
    told = {k: c for k, c in fields(value).items() if k != "payload"}
    # The archives are read once: how they are split, and so what a segment is called, may change from one read to the next.
    segments = scanned(spark, path, F.octet_length("value").cast("long").alias("bytes"), length(value).cast("long").alias("long"), F.struct(*[c.alias(k) for k, c in told.items()]).alias("own"))
    segments = cut(segments, "segments")
    held = cut(placed(segments.drop("value")), "places")
    candidates = held.filter("at >= 0 AND long IS NOT NULL").withColumn("end", F.col("at") + F.col("long"))
    whole = candidates.join(chained(candidates), ["archive", "at"], "left_semi")
    whole = cut(whole.select("archive", "block", "seq", "at", "end", "own", (F.col("bytes") + len(MAGIC) == F.col("long")).alias("alone")), "records")
    alone, pieced = whole.filter("alone"), whole.filter("NOT alone")
    texts = segments.select(*RANGE, "seq", "value")
    key = [*RANGE, "seq"]
    if payloads:
        out = alone.select(*key, "own").join(texts, key).select("own.*", fields(value)["payload"].alias("payload"))
    else:
        out = alone.select("own.*")
    if not pieced.limit(1).isEmpty():
        # A record's pieces: what starts between its start and its end, found by slots of the archive.
        slot = lambda c: F.floor(c / SLOT)
        owners = pieced.select("archive", F.col("at").alias("owner"), "end", F.explode(F.sequence(slot(F.col("at")), slot(F.col("end")))).alias("slot"))
        parts = held.select("archive", "block", "seq", "at", slot(F.col("at")).alias("slot")).join(owners, ["archive", "slot"]).filter("at >= owner AND at < end")
        joined = parts.select(*key, "at", "owner").join(texts, key).groupBy("archive", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("parts"))
        again = joined.select(F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC).alias("value"))
        out = out.unionByName(again.select(*[c.alias(k) for k, c in fields(value).items() if k in wanted]))
    return out.select(*wanted)


def round_trip(pages: DataFrame, path: str, payloads: bool = True, **options) -> DataFrame:
    """Write pages as archives under path and read them back."""
    write(pages, path, **options)
    if pages.limit(1).isEmpty():
        return pages.sparkSession.createDataFrame([], SCHEMA).select(*[c for c in FIELDS if payloads or c != "payload"])
    return read(pages.sparkSession, path, payloads)
