"""WARC archives written with an index, and read back by coalesced byte ranges.

Writing needs no shuffle of payloads beyond the join that finds equal ones: each task
appends its records to files of its own and returns an index row per record. The index is
what makes a file part of the archive: a task that is run again writes other files, and
those of the lost attempt are in no index row. Records are gzip members of their own, so
any of them can be read by offset and length alone.

Reading starts from the index: the wanted rows are dealt out in file order, neighbouring
ranges are read as one, and only their bytes are fetched.

The folder may be on any file system that pyarrow opens by URI (a local or mounted path,
HDFS, object stores); on a cluster it has to be one that all executors share.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.session import scratch_path
from faultline.sources.tables import stage

MIN_REVISIT_BYTES = 100
FILE_BYTES = 1 << 30
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
ROWS_PER_READER = 50_000

#: Ids pass through pandas as text: a whole-number column with nulls would become floating point there.
_WRITTEN = (
    "id string, url string, record_type string, refers_to string, digest string, payload_bytes bigint, "
    "file string, offset bigint, length bigint")
_READ = "id string, url string, record_type string, refers_to string, header_digest string, payload binary"


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """What is written for each row: id, url, payload, digest, record_type, refers_to.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes those with the
    smallest id are responses, the others revisit it. A null payload is empty. Rows that
    repeat the smallest id are responses each; a row without an id revisits if any equal
    one has an id. Only digests and ids are grouped, merged before the shuffle; the payloads
    meet the (few) digests that occur twice in a join that Spark splits where one is hot.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("digest"))
    firsts = (
        rows.where(F.length("payload") >= MIN_REVISIT_BYTES)
        .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    firsts = stage(firsts, "warc-firsts")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select(
        "id", "url", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def _name(key: str | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _key(name: str | None) -> str | None:
    return name[len("<urn:page:"):-1] or None if name else None


def _numbered(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if c in ("id", "refers_to") else c for c in df.columns))


def _line(text: str | None) -> str:
    """A header value on one line; what WARC forbids there is percent-coded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in "%\x7f" else c for c in text or "")


def record(key: str | None, url: str | None, kind: str, refers_to: str | None, digest: str, payload: bytes) -> bytes:
    """One record as a gzip member. Revisits carry no payload but name the record that does."""
    body = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(key)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def parsed(member: bytes) -> dict:
    """The record in a gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    url = fields.get("WARC-Target-URI")
    return {
        "id": _key(fields["WARC-Record-ID"]), "url": None if url is None else _unline(url),
        "record_type": fields["WARC-Type"], "refers_to": _key(fields.get("WARC-Refers-To")),
        "header_digest": fields["WARC-Payload-Digest"].partition(":")[2], "payload": rest[:size],
    }


def _unline(text: str) -> str:
    head, *parts = text.split("%")
    return head + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts)


def _opened(uri: str):
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the planned records below ``folder`` and return their index, itself written as Parquet.

    The index holds id, url, record_type, refers_to, digest, payload_bytes, file, offset and
    length of every record.
    """
    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(folder)
        system.create_dir(base, recursive=True)
        out, file, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.itertuples(index=False):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{file}", compression=None)
                    head = row.id, row.url, row.record_type, row.refers_to, row.digest
                    member = record(*head, row.payload)
                    out.write(member)
                    index.append((*head, len(row.payload), file, at, len(member)))
                    at += len(member)
                yield pd.DataFrame(index, columns=[c.split()[0] for c in _WRITTEN.split(", ")])
        finally:
            if out is not None:
                out.close()

    rows = plan.select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", "record_type",
        F.col("refers_to").cast("string").alias("refers_to"))
    return stage(_numbered(rows.mapInPandas(written, _WRITTEN)), "warc-index")


def runs(index: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of one file, in order of offset, that are worth one read."""
    index = index.sort_values(["file", "offset"], kind="stable")
    start = 0
    files, offsets, lengths = index["file"].tolist(), index["offset"].tolist(), index["length"].tolist()
    for i in range(1, len(index) + 1):
        if (
            i == len(index) or files[i] != files[start]
            or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > GAP_BYTES
            or offsets[i] + lengths[i] - offsets[start] > RANGE_BYTES
        ):
            yield index.iloc[start:i]
            start = i


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows: id, url, record_type, refers_to, header_digest, payload.

    Give it a filtered index to read a selection. Rows are dealt out by file and offset, in
    ranges of about ``ROWS_PER_READER`` rows.
    """
    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _opened(folder)
        for batch in batches:
            for run in runs(batch):
                first, sizes = int(run["offset"].iloc[0]), run["length"].tolist()
                starts = [int(o) - first for o in run["offset"]]
                with system.open_input_file(f"{base}/{run['file'].iloc[0]}") as source:
                    source.seek(first)
                    block = source.read(starts[-1] + sizes[-1])
                yield pd.DataFrame([parsed(block[a:a + n]) for a, n in zip(starts, sizes)])

    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-index.count() // ROWS_PER_READER))
    wanted = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset")
    return _numbered(wanted.sortWithinPartitions("file", "offset").mapInPandas(fetched, _READ))


def resolved(records: DataFrame) -> DataFrame:
    """Per record id, url, record_type, refers_to, payload_bytes and payload_digest of the full payload.

    A response's are taken from its bytes. A revisit's come from the response that it names,
    whose computed digest must be the one in the revisit's header.
    """
    read = records.select(
        "id", "url", "record_type", "refers_to", "header_digest",
        F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    read = stage(read, "warc-records")
    plain = read.where(F.col("record_type") != "revisit").drop("header_digest")
    known = plain.groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(
        F.max("payload_bytes").alias("payload_bytes"))
    known = stage(known.where(F.col("refers_to").isNotNull()), "warc-responses")
    again = read.where(F.col("record_type") == "revisit").drop("payload_bytes", "payload_digest")
    found = again.join(known, ["refers_to", "header_digest"], "left")
    return plain.unionByName(found.withColumnRenamed("header_digest", "payload_digest"))


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared scratch space."""
    return scratch_path(spark, "warc")
