"""WARC archives of pages, read back by boundary chains.

Writing: one record a row, by Spark's text writer, whose line separator is the
blank line that ends a record; so archives can lie in any store Spark writes to.
Copies of a payload become revisit records without the payload.

Reading: Spark's text reader cuts the files, in splits of any size, where a blank line and the
tag ``WARC/1.`` stand, which may also be inside a payload. A task emits each such place as a
candidate with the offset that its Content-Length claims for the next record. From the
start of the file, pointer jumping keeps the candidates on the chain; all others are
rejected. Inside a split the jumps are NumPy; from split to split they are joins over (file,
offset), in as many rounds as the logarithm of a file's splits. What a record is, is decided
after that, and a chain that does not end with its file is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgrid.llm.common import new_path, written

MIN_REVISIT = 1000
FILE_BYTES = 8 << 20
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files under ``path``.

    Of rows with equal payloads of ``min_revisit`` bytes or more, that with the
    largest page_id is the response and the others revisit it; rows that share this
    page_id are responses all. Null html is an empty payload, a null url an empty
    URI, control characters in urls are percent-encoded, and a row without page_id can be a
    revisit but is not referred to. An empty table gives a folder without records."""
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    clean = clean.withColumns({"n": F.octet_length("html"), "digest": F.sha1("html")})
    mean = clean.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    copies = clean.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    copies = written(copies.where("copies > 1 and first is not null").drop("copies"), "copies")
    few = copies.count() <= BROADCAST_ROWS  # payloads that come more than once; beyond the bound, pages are dealt by digest
    rows = clean.join(F.broadcast(copies) if few else copies, "digest", "left")
    revisit = (F.col("n") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    per_file = max(1, int(file_bytes / (mean + 500)))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


SEPARATOR = b"\r\n\r\nWARC/1."
TAG = 7  # of these bytes belong to the record that follows
SHA1 = re.compile(r"(?i)sha1:([0-9a-f]{40}|[a-z2-7]{32})")
CANDIDATE = "file string, block long, rel long, size long, claimed long, whole boolean"
FOUND = "record_type string, record_id string, url string, refers string, payload_bytes long, payload_digest string, intact boolean"
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {name: KINDS[kind] for name, kind in (f.split() for f in schema.split(", "))}


def header(row: bytes, first: bool) -> tuple[dict[str, str], int, int] | None:
    """Of a row of the text reader (bytes after a separator, or from the start of the file): the
    record's fields, where its block begins and how long it is; None if it cannot be a record."""
    at = TAG if first else 0
    if first and not row.startswith(SEPARATOR[-TAG:]) or row[at : at + 3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = row.find(b"\r\n\r\n", at)
    end = len(row) if end < 0 else end  # a payload that begins with the tag
    found: dict[str, str] = {}
    for line in row[at + 3 : end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        found.setdefault(name.decode("utf-8", "replace").strip().lower(), value.decode("utf-8", "replace").strip())
    size = found.get("content-length", "")
    return (found, end + 4, int(size)) if size.isascii() and size.isdigit() else None


def decided(found: dict[str, str], block: bytes | None) -> list:
    """The ``FOUND`` columns of a record; without its block what the fields say alone."""
    kind, said = found.get("warc-type", ""), SHA1.search(found.get("warc-payload-digest", ""))
    length = found.get("warc-payload-length", "")
    n, digest, intact = int(length) if length.isdigit() else None, said.group(1) if said else None, True
    if block is not None and kind != "revisit":
        http = "application/http" in found.get("content-type", "")
        payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else block
        raw = hashlib.sha1(payload).digest()
        forms = (raw.hex(), base64.b32encode(raw).decode().lower())
        intact = (digest is None or digest.lower() in forms) and n in (None, len(payload))
        n, digest = len(payload), raw.hex()
    return [kind, found.get("warc-record-id"), found.get("warc-target-uri", ""), found.get("warc-refers-to"), n, digest, intact]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split), value (bytes) in the order of the file."""
    rows = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes]]:
    """(file, block), place in the split, bytes of each row; rows of a split come in turn."""
    split, rel = None, 0
    for batch in batches:
        for name, block, value in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (name, block) != split:
                split, rel = (name, block), 0
            yield split, rel, value
            rel += len(value) + len(SEPARATOR)


def _candidates(rows: DataFrame) -> DataFrame:
    """``CANDIDATE`` and ``FOUND`` columns of each row; ``claimed`` is the length that it claims from
    the row's start to the next row's, null if it cannot be a record, and ``whole`` says that its block lies in the row."""
    kinds = _fields(f"{CANDIDATE}, {FOUND}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def full() -> pa.RecordBatch:
            arrays = [pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * len(kinds), kinds.values())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, list(kinds))

        for (name, block), rel, value in _placed(batches):
            first = block == rel == 0
            got = header(value, first)
            place = [name, block, rel, len(value) + len(SEPARATOR)]
            if got is None:
                out.append([*place, None, None, *[None] * 7])
            else:
                found, at, n = got
                whole = at + n <= len(value)
                out.append([*place, at + n + 4 + (0 if first else TAG), whole, *decided(found, value[at : at + n] if whole else None)])
            if len(out) >= 4096:
                yield full()
        yield full()

    return rows.mapInArrow(run, f"{CANDIDATE}, {FOUND}")


def reachable(offset: np.ndarray, following: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates lie on the chain from the entries, and the first place outside of
    ``offset`` that each one's chain comes to: each round doubles the jumps."""
    by = np.argsort(offset, kind="stable")
    n = len(offset)
    at = np.searchsorted(offset[by], following)
    near = by[np.minimum(at, n - 1)]
    jump = np.append(np.where((at < n) & (offset[near] == following), near, n), n)
    on, last = np.append(entry, False), np.append(np.arange(n), n)
    for _ in range(max(1, n.bit_length())):
        on[jump[on]] = True
        on[n] = False
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    return on[:n], following[last[:n]]


def _per_split(rows: DataFrame, schema: str, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return rows.groupBy("file", "block").applyInArrow(f, schema)


def _on_chain(found: DataFrame, splits: DataFrame) -> DataFrame:
    """The rows of ``found`` (file, block, offset, next and others) on the chain from their file's start."""
    most = splits.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    entries = found.where("offset = 0").select("file", "offset")

    def exits(t: pa.Table) -> pa.Table:
        offset, following = t.column("offset").to_numpy(), t.column("next").to_numpy()
        _, out = reachable(offset, following, np.zeros(len(offset), bool))
        return pa.table({"file": t.column("file"), "offset": t.column("offset"), "to": pa.array(out)})

    jumps = None
    for _ in range(int(most - 1).bit_length()):  # a jump leaves a split at least
        if jumps is None:
            jumps = written(_per_split(found.select("file", "block", "offset", "next"), "file string, offset long, to long", exits), "jumps")
        further = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        entries = written(entries.unionByName(entries.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "entries")
        jumps = written(jumps.join(further, ["file", "to"], "left").select("file", "offset", F.coalesce("beyond", "to").alias("to")), "jumps")

    def kept(t: pa.Table) -> pa.Table:
        on, _ = reachable(t.column("offset").to_numpy(), t.column("next").to_numpy(), np.array(t.column("entry").to_pylist(), bool))
        return t.filter(pa.array(on)).drop_columns(["entry"])

    rows = found.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left").select(*found.columns, F.coalesce("entry", F.lit(False)).alias("entry"))
    return _per_split(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema), kept)


def _reassembled(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """file, offset and the ``FOUND`` columns of records that are cut by separators in their
    payloads; ``parts``: file, block, rel of their rows, owner (the record's offset) and at (the row's)."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split, rel, value in _placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((split[0], pa.string()), (split[1], pa.int64()), (rel, pa.int64()), (value, pa.binary()))], ["file", "block", "rel", "value"])

    def whole(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        owner = key[1].as_py()
        data = SEPARATOR.join(t.column("value").to_pylist())
        found, at, n = header(data, owner == 0)
        row = [key[0].as_py(), owner, *decided(found, data[at : at + n])]
        return pa.table([pa.array([x], k) for x, k in zip(row, _fields(f"file string, offset long, {FOUND}").values())], list(_fields(f"file string, offset long, {FOUND}")))

    rows = _rows(spark, path).mapInArrow(fetched, "file string, block long, rel long, value binary")
    return rows.join(parts, ["file", "block", "rel"]).select("file", "owner", "at", "value").groupBy("file", "owner").applyInArrow(whole, f"file string, offset long, {FOUND}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, one row each, without payloads: file, offset,
    next, record_type, record_id, url, refers, payload_bytes, payload_digest (bare hex SHA-1 of the
    payload; of revisits, and records without, what the fields say), intact (the fields agree with the payload),
    and page_id, refers_to where the ids are numbers of this module's form.

    Any records with a Content-Length are read, of any type and from any writer; an archive
    whose chain of records does not end with the file is an error (ValueError). A folder without
    records gives no row. Any payload fits in memory; files may be of any size."""
    rows = written(_candidates(_rows(spark, path)), "candidates")
    splits = rows.groupBy("file", "block").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = written(splits.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "splits")
    start = F.col("base") + F.col("rel")  # of the row; its record's tag stands before it, but for the first
    offset = F.when(start == 0, 0).otherwise(start - TAG)
    placed = rows.join(splits.drop("n"), ["file", "block"]).withColumn("offset", offset)
    found = placed.where("claimed is not null").withColumn("next", F.col("offset") + F.col("claimed"))
    kept = written(_on_chain(found.drop("base"), splits), "records")

    ends = splits.groupBy("file").agg((F.sum("n") - len(SEPARATOR)).alias("length")).join(kept.groupBy("file").agg(F.max("next").alias("end")), "file", "left")
    broken = ends.where("length > 0 and not length <=> end").limit(5).collect()
    if broken:
        raise ValueError("no chain of records up to the end: " + ", ".join(f"{r['file']} ({r['end'] or 0} of {r['length']})" for r in broken))
    columns = [f.split()[0] for f in FOUND.split(", ")]
    cut = kept.where("not whole")
    if not cut.isEmpty():
        heads = kept.select("file", "offset", F.col("offset").alias("head"))
        owned = placed.join(heads, ["file", "offset"], "left").withColumn("owner", F.last("head", True).over(Window.partitionBy("file").orderBy("offset")))
        parts = owned.join(cut.select("file", F.col("offset").alias("owner")), ["file", "owner"], "left_semi")
        parts = written(parts.select("file", "block", "rel", "owner", F.col("offset").alias("at")), "parts")
        mended = _reassembled(spark, path, parts).join(cut.select("file", "offset", "next"), ["file", "offset"])
        kept = kept.where("whole").select("file", "offset", "next", *columns).unionByName(mended.select("file", "offset", "next", *columns))
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return kept.select("file", "offset", "next", *columns, number("record_id").alias("page_id"), number("refers").alias("refers_to"))


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, min_revisit)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


SQL = """
with p as (select page_id, url, coalesce(html, '') as h from pages),
s as (select page_id, url, strlen(h) as n, sha1(h) as d from p),
g as (select *, max(page_id) over (partition by d, n) as first from s)
select page_id, n as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> first then first end as refers_to,
       replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as url, true as intact
from g
"""
