"""WARC files as a Spark data source: written by records, read by planned file partitions.

A folder may be written to several times and hold archives from elsewhere too,
gzipped or not: each write adds a manifest of its own files, and files that
look like those of a write count only where a manifest names them.

The reader takes filters on record_type, target_uri and other header columns,
parses the headers of a record first, and steps over the payload of a record
that a filter drops, or whose payload is not asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from contextlib import nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..session import materialize, scratch_path
from .common import small_batches
from .files import opened, write_whole

#: A file is closed beyond this size, and a reading task takes files up to it.
FILE_BYTES = 64 << 20
#: Names of the manifest and of the archives of one write.
MANIFEST, PART = re.compile(r"_manifest-[0-9a-f]{32}\.json"), re.compile(r"part-[0-9a-f]{32}\.warc")

HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "full_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(values: dict, payload: bytes) -> bytes:
    """One WARC 1.1 record; header values lose line breaks, null ones are left out."""
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        if values.get(column) is not None:
            lines.append(f"{header}: " + " ".join(str(values[column]).split("\n")).replace("\r", " "))
    if values.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def read_records(file, wanted, payloads: bool) -> Iterator[tuple[dict, bytes | None]]:
    """(headers in lower case, payload) of the records that `wanted(headers)` takes.

    Only headers are parsed of the others. `file` reads and seeks.
    """
    buffer, at, ended = b"", 0, False

    def fill(size):
        nonlocal buffer, at, ended
        while len(buffer) - at < size and not ended:
            more = file.read(max(1 << 16, size - (len(buffer) - at)))
            ended = not more
            buffer, at = buffer[at:] + more, 0

    while True:
        fill(1)
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 and not ended:
            fill(len(buffer) - at + 1)
        if end < 0:
            if buffer[at:].strip():
                raise ValueError("the file ends within a record's headers")
            return
        lines = buffer[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record starts with {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size, at = int(headers["content-length"]), end + 4
        if payloads and wanted(headers):
            fill(size + 4)
            if len(buffer) - at < size:
                raise ValueError("the file ends within a payload")
            yield headers, buffer[at : at + size]
            at += size + 4
            continue
        if wanted(headers):
            yield headers, None
        ahead = size + 4 - (len(buffer) - at)
        if ahead > 0:  # beyond what has been read: step over it
            file.seek(ahead, 1)
            buffer, at = b"", 0
        else:
            at += size + 4


def unzipped(file, name: str):
    """`file`, or the content of its gzip members one after the other, as .warc.gz files have a member per record."""
    return gzip.GzipFile(fileobj=file) if name.endswith(".gz") else nullcontext(file)


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool, pushdown: bool = True):
        self.path, self.payloads, self.pushdown, self.tests = path, payloads, pushdown, []

    def pushFilters(self, filters):
        """Takes equality and membership tests of header columns; the rest is left to Spark."""
        for f in filters:
            if self.pushdown and isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((HEADERS[f.attribute[0]].lower(), values))
            else:
                yield f

    def partitions(self):
        """Archives (*.warc, *.warc.gz) below the path in groups of up to FILE_BYTES; an error if there is none.

        Where there are manifests, files of writes count if one names them. A
        gzipped file cannot be entered in its middle, so a file is never divided.
        """
        from pyarrow import fs

        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File]
        listed, manifests = set(), [f for f in found if MANIFEST.fullmatch(f.base_name)]
        for manifest in manifests:
            with store.open_input_stream(manifest.path) as file:
                listed.update(posixpath.join(posixpath.dirname(manifest.path), name) for name, _ in json.loads(file.read()))
        written = {posixpath.dirname(m.path) for m in manifests}
        files = [
            (f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))
            and (f.path in listed or posixpath.dirname(f.path) not in written or not PART.fullmatch(f.base_name))
        ]
        if not files and not manifests:
            raise ValueError(f"no .warc or .warc.gz file in {self.path}")
        if missing := listed - {name for name, _ in files}:
            raise ValueError(f"{len(missing)} files that a manifest names are gone, such as {min(missing)}")
        groups: list[list[str]] = []
        room = 0
        for name, size in sorted(files):
            if size > room or not groups:
                groups.append([])
                room = FILE_BYTES
            groups[-1].append(name)
            room -= size
        return [Files(g) for g in groups]

    def read(self, partition):
        store, _ = opened(self.path)

        def wanted(headers):
            return all(headers.get(h) in values for h, values in self.tests)

        rows, held = [], 0
        for name in partition.names if partition else ():  # no files: Spark asks for one partition all the same
            with store.open_input_file(name) as raw, unzipped(raw, name) as file:
                for headers, payload in read_records(file, wanted, self.payloads):
                    rows.append((*(headers.get(h.lower()) for h in HEADERS.values()), int(headers["content-length"]), payload))
                    held += 500 + len(payload or b"")
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), _TYPES)], names=[*HEADERS, "content_length", "payload"])


class WarcWriter(DataSourceArrowWriter):
    """Files of one task attempt have names of their own; the manifest names those of the attempts that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        store, path = opened(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for values in (row for batch in iterator for row in batch.to_pylist()):
            if out is None:
                name = f"part-{uuid.uuid4().hex}.warc"
                out, size = store.open_output_stream(f"{path}/{name}"), 0
            data = record(values, values.get("payload") or b"")
            out.write(data)
            size += len(data)
            if size > FILE_BYTES:
                out.close()
                files.append((name, size))
                out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        """Adds this write's manifest; when overwriting, those of earlier writes then go and their files no longer count."""
        from pyarrow import fs

        store, path = opened(self.path)
        name = f"_manifest-{uuid.uuid4().hex}.json"
        names = sorted(f for m in messages if m is not None for f in m.files)
        write_whole(self.path, name, [json.dumps(names).encode()])
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if MANIFEST.fullmatch(f.base_name) and f.base_name != name:
                    store.delete_file(f.path)

    def abort(self, messages):
        """Without a manifest, or not named in it, files do not count."""


class WarcSource(DataSource):
    """format("warc"): option path; option payloads (default true) false leaves payload null.

    Option pushdown (default false) lets the reader drop records by the query's
    filters. Spark keeps one plan of reading for all scans of a loaded frame, so
    only a frame that is used once, with one filter, may ask for it.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        given = {name: self.options.get(name, default).lower() == "true" for name, default in (("payloads", "true"), ("pushdown", "false"))}
        return WarcReader(self.options["path"], **given)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Rows to write, one per page: of equal payloads of at least `least` bytes the one with the
    largest page_id is the response and the others revisit it; smaller ones are all responses.

    page_id null counts as the largest negative number; rows that repeat a
    page_id as well as its payload are all responses. A null html is empty. An
    empty table gives no records; other columns are not read.
    """
    full = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("page_id"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("full"))
    keyed = full.withColumn("sha", F.sha1("full")).withColumn("n", F.octet_length("full").cast("long"))
    slim = full.select("page_id", F.sha1("full").alias("sha"), F.octet_length("full").cast("long").alias("n"))
    last = materialize(slim.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("rows_")).where("rows_ > 1"), "warc-shared")
    joined = keyed.join(last, ["sha", "n"], "left")
    revisit = F.coalesce(F.col("page_id") != F.col("last"), F.lit(False))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("date"),
        F.concat(F.lit("sha1:"), _base32(F.col("sha"))).alias("payload_digest"),
        F.when(revisit, F.concat(F.lit("<urn:page:"), "last", F.lit(">"))).alias("refers_to"),
        F.col("n").cast("string").alias("full_length"),
        F.lit(None).cast("long").alias("content_length"),
        F.when(~revisit, F.col("full")).alias("payload"),
    )


def _base32(sha):
    """Base32 of a hex digest of 40 characters: five bits a character, four bits a hex digit."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    five = [F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1 for i in range(32)]
    return F.concat(*[F.substring(letters, at, F.lit(1)) for at in five])


def write_warc(rows: DataFrame, folder: str) -> None:
    """Adds the rows as records to what the folder holds."""
    register(rows.sparkSession)
    small_batches(rows).write.format("warc").mode("append").save(folder)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True, pushdown: bool = False) -> DataFrame:
    """All records below the folder. pushdown: see `WarcSource`; without it Spark filters what was read."""
    register(spark)
    options = {"payloads": str(payloads).lower(), "pushdown": str(pushdown).lower()}
    return spark.read.format("warc").options(**options).load(folder)


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")


def page_number(column):
    return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of `records`.

    A response is measured from the payload that the archive holds; a revisit
    from its own headers, so its records are read without a payload.
    """
    responses = read_warc(spark, folder, pushdown=True).where("record_type = 'response'").select("record_id", "record_type", "refers_to", "payload")

    def measure(batches):
        for batch in batches:
            data = [x or b"" for x in batch.column("payload").to_pylist()]
            out = batch.drop_columns(["payload"]).append_column("payload_bytes", pa.array([len(x) for x in data], pa.int64()))
            yield out.append_column("payload_digest", pa.array([digest(x) for x in data], pa.string()))

    measured = responses.mapInArrow(measure, "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string")
    revisits = read_warc(spark, folder, payloads=False, pushdown=True).where("record_type = 'revisit'").select(
        "record_id", "record_type", "refers_to", F.col("full_length").cast("long").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
    )
    both = measured.unionByName(revisits)
    return both.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.when(F.col("refers_to").isNotNull(), page_number("refers_to")).alias("refers_to"))
