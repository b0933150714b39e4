"""Archives come back as they were written; filters skip payloads."""

import base64
import gzip
import hashlib
import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flightseal.llm import warc
from flightseal.llm.queries import op4_warc
from tests.conftest import SF


def plain(pages, least=0):
    by = {}
    for i, html in pages:
        by.setdefault(html or "", []).append(i)
    out = {}
    for i, html in pages:
        data = (html or "").encode()
        last = max(by[html or ""]) if len(data) >= least else i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if last == i else "revisit", None if last == i else last)
    return out


def as_dict(rows):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows}


def test_query(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert as_dict(op4_warc(spark, SF).collect()) == plain(pages)


def odd(spark):
    pages = [(1, "u\r\nX: 1", "a\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "v", ""), (4, "w", "é" * 50000), (5, "w", "é" * 50000), (6, "x", "same"), (7, "x", "same"), (8, "y", "same"), (-5, "", "same")]
    return spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, payload string"), [(p[0], p[2]) for p in pages]


@pytest.mark.parametrize("size, least", [(64 << 20, 0), (100, 0), (1000, 5)])
def test_odd_rows(spark, monkeypatch, size, least):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    frame, pages = odd(spark)
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(frame.repartition(3), least), folder)
    assert as_dict(warc.archived(spark, folder).collect()) == plain(pages, least)
    back = {r.page_id: r.payload for r in warc.read_warc(spark, folder).where("record_type = 'response'").select(warc.page_number("record_id").alias("page_id"), "payload").collect()}
    assert all(bytes(back[i]) == (dict(pages)[i] or "").encode() for i in back)


def test_empty_and_repeated(spark):
    frame, _ = odd(spark)
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(frame.limit(0)), folder)
    assert warc.archived(spark, folder).count() == 0
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(frame.union(frame)), folder)
    assert warc.archived(spark, folder).count() == 18


def test_writes_add_up(spark):
    """A second write adds its records, overwriting replaces them, and files that no manifest names do not count."""
    frame, _ = odd(spark)
    folder = warc.archive_folder(spark)
    rows = warc.records(frame)
    warc.write_warc(rows.where("record_id = '<urn:page:1>'"), folder)
    warc.write_warc(rows.where("record_id <> '<urn:page:1>'"), folder)
    assert warc.read_warc(spark, folder).count() == 9
    with open(f"{folder}/part-{'0' * 32}.warc", "wb") as file:  # of a failed attempt
        file.write(warc.record({"record_type": "response"}, b"x"))
    assert warc.read_warc(spark, folder).count() == 9
    rows.limit(2).write.format("warc").mode("overwrite").save(folder)
    assert warc.read_warc(spark, folder).count() == 2
    with open(f"{folder}/foreign.warc", "wb") as file:
        file.write(warc.record({"record_type": "response"}, b"x"))
    assert warc.read_warc(spark, folder).count() == 3


def test_gzipped_archives(spark, tmp_path):
    """A gzip member per record, as crawlers write them, beside a plain file."""
    made = [warc.record({"record_type": t, "record_id": str(i)}, bytes([65 + i]) * 200000) for i, t in enumerate(["response", "warcinfo", "response"])]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in made))
    (tmp_path / "b.warc").write_bytes(b"".join(made))
    (tmp_path / "notes.txt").write_text("x")
    read = warc.read_warc(spark, str(tmp_path))
    got = Counter((r.record_id, bytes(r.payload)) for r in read.where("record_type = 'response'").collect())
    assert got == {("0", b"A" * 200000): 2, ("2", b"C" * 200000): 2}
    assert read.count() == 6
    assert warc.read_warc(spark, str(tmp_path), payloads=False).where("record_type = 'warcinfo'").count() == 2
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no .warc"):
        warc.read_warc(spark, str(tmp_path / "none")).count()


def test_filters_reach_the_source(spark):
    frame, _ = odd(spark)
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(frame), folder)
    read = warc.read_warc(spark, folder, pushdown=True)
    assert read.where((F.col("record_type") == "response") & F.col("target_uri").isin("w", "y")).count() == 2
    reader = warc.WarcReader(folder, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("content_length",), 3), GreaterThan(("date",), "x")]))
    assert len(kept) == 2 and reader.tests == [("warc-type", {"revisit"})]


def test_a_frame_serves_several_filters(spark):
    frame, _ = odd(spark)
    folder = warc.archive_folder(spark)
    warc.write_warc(warc.records(frame), folder)
    read = warc.read_warc(spark, folder)
    first, second = read.where("record_type = 'response'"), read.where("record_type = 'revisit'")
    counts = first.count(), second.count()
    assert min(counts) > 0 and sum(counts) == read.count() == first.unionAll(second).count() == 9


def test_unwanted_payloads_are_stepped_over():
    class File(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    data = b"".join(warc.record({"record_type": t, "record_id": str(i)}, bytes(1 << 20)) for i, t in enumerate(["response", "revisit", "response"]))
    file = File(data)
    got = list(warc.read_records(file, lambda h: h["warc-type"] == "revisit", True))
    assert [(h["warc-record-id"], len(p)) for h, p in got] == [("1", 1 << 20)]
    assert file.taken < len(data) * 0.6
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-50]), lambda h: True, True))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"junk\r\n\r\n"), lambda h: True, True))
