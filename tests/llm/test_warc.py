"""Archives: written, indexed, selected, read back."""

import hashlib
import os

import pytest

from faultline.llm import warc
from faultline.llm.queries import QUERIES

BIG = "<p>été</p>" * 40
ROWS = [
    (1, "http://a/", BIG), (2, "http://b/", BIG), (3, None, BIG), (4, "http://c/\r\nX: 1%41", "small"), (5, "http://d/", "small"),
    (6, "", None), (7, "http://e/", ""), (None, "http://f/", BIG), (None, "http://g/", "y" * 200), (None, "http://h/", "y" * 200),
    (8, "http://i/", "a\r\n\r\nb" * 100_000), (9, "http://j/", "z" * 99), (10, "http://k/", "z" * 99), (1, "http://a/", BIG),
    (2**60 + 1, "http://l/", BIG),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "own", 5) for r in ROWS], "page_id bigint, url string, html string, digest string, offset int")


@pytest.fixture(scope="module")
def written(spark, pages):
    folder = warc.archive_folder(spark)
    return warc.write_archives(warc.planned(pages), folder), folder


def test_round_trip(written):
    index, folder = written
    rows = warc.resolved(warc.read_records(index, folder)).collect()
    got = sorted((r["id"] or -1, r["url"] or "", r["record_type"], r["refers_to"] or -1, r["payload_bytes"], r["payload_digest"]) for r in rows)
    want = []
    for key, url, html in ROWS:
        raw = (html or "").encode()
        kind, refers = "response", None
        if html == BIG and key != 1:
            kind, refers = "revisit", 1
        want.append((key or -1, url or "", kind, refers or -1, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want)


def test_a_selection_is_read_by_its_ranges(written):
    index, folder = written
    rows = warc.read_records(index.where("id in (4, 8)"), folder).collect()
    assert {r["id"]: bytes(r["payload"]).decode() for r in rows} == {4: "small", 8: "a\r\n\r\nb" * 100_000}


def test_ranges_are_coalesced():
    import pandas as pd

    gap, far = warc.GAP_BYTES, warc.RANGE_BYTES
    index = pd.DataFrame({
        "file": ["b", "a", "a", "a", "a", "a"], "offset": [0, 0, 10, 30 + gap, 31 + 2 * gap + 10, far * 2],
        "length": [5, 10, 20, 10, 10, far * 3]})
    assert [len(r) for r in warc.runs(index)] == [3, 1, 1, 1]


def test_files_hold_whole_records(written):
    index, folder = written
    sizes = {r["file"]: r["n"] for r in index.groupBy("file").agg({"length": "sum"}).toDF("file", "n").collect()}
    assert sizes == {f: os.path.getsize(f"{folder}/{f}") for f in sizes}


def test_empty_table(spark, pages):
    folder = warc.archive_folder(spark)
    index = warc.write_archives(warc.planned(pages.where("false")), folder)
    assert warc.resolved(warc.read_records(index, folder)).count() == 0


def test_query_has_every_page(spark, sf):
    html = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op10_warc"](spark, sf).collect()
    assert {r["page_id"]: r["payload_digest"] for r in rows} == {
        k: hashlib.sha256(v.encode()).hexdigest() for k, v in html.items()}
