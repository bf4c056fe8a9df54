"""Sensor files: documentation lines, then a header line, then comma rows.

Within a task Spark hands over the lines of a file in order, and the first split of a file
starts with its first line; so a pass over the first splits drops everything up to the header
by position, whatever those lines hold. Only first splits meet Python: the lines of later
splits stay in the JVM, in a scan of their own. No file is opened by a job of its own, and no
line is compared by value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from faultline import schema as S
from faultline.operators.clean import nullify_tokens, to_numeric, trim_column_names

_HEAD_LINES = 64
_DELIMITERS = (",", ";", "\t")
_BAD = "__unparsed"


@dataclass(frozen=True)
class FileHead:
    path: str
    row: int
    header: str
    delimiter: str

    @property
    def names(self) -> tuple[str, ...]:
        return header_names(self.header, self.delimiter)


def header_names(line: str, delimiter: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in line.strip("\r\n").split(delimiter))


def header_delimiter(line: str) -> str | None:
    """The delimiter if the line is a header: it starts with ``class`` and names a sensor."""
    text = line.strip().lower()
    if "_000" not in text:
        return None
    return next((d for d in _DELIMITERS if text.startswith("class" + d)), None)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Data files below a path, without reading them."""
    return sorted(spark.read.text(path).inputFiles())


def find_header(spark: SparkSession, path: str, skip_rows: int | None = None) -> FileHead:
    """Read only the head of one file, further each time until the header shows."""
    lines_wanted = _HEAD_LINES if skip_rows is None else skip_rows + 1
    while True:
        lines = [r[0] for r in spark.read.text(path).limit(lines_wanted).collect()]
        if skip_rows is not None:
            if len(lines) <= skip_rows:
                raise ValueError(f"{path} has no header after {skip_rows} lines")
            header = lines[skip_rows]
            return FileHead(path, skip_rows, header, header_delimiter(header) or ",")
        for i, line in enumerate(lines):
            if delimiter := header_delimiter(line):
                return FileHead(path, i, line, delimiter)
        if len(lines) < lines_wanted:
            raise ValueError(f"no header line found in {path}")
        lines_wanted *= 8


def find_header_row(spark: SparkSession, path: str) -> int:
    """Zero-based line number of the header in one file."""
    return find_header(spark, path).row


class _FileState:
    """Where a task stands in the file it reads: lines seen, and the delimiter once the header is passed."""

    def __init__(self, names: tuple[str, ...], skip_rows: int | None):
        self.names, self.skip_rows = tuple(n.lower() for n in names), skip_rows
        self.path, self.seen, self.delimiter = None, 0, None

    def enter(self, path: str) -> None:
        self.leave()
        self.path, self.seen, self.delimiter = path, 0, None

    def leave(self) -> None:
        """A first split that ends without a header is an error: its rows cannot be told apart."""
        if self.path is not None and self.delimiter is None:
            raise ValueError(f"no header line found in the first split of {self.path}")

    def rows_before_data(self, lines: Sequence[str]) -> int:
        """How many of the next lines come before the data; notes the header among them."""
        for i, line in enumerate(lines):
            if self.skip_rows is None:
                delimiter = header_delimiter(line)
            else:
                delimiter = (header_delimiter(line) or ",") if self.seen == self.skip_rows else None
            self.seen += 1
            if delimiter:
                if tuple(n.lower() for n in header_names(line, delimiter)) != self.names:
                    raise ValueError(f"{self.path} has different columns")
                self.delimiter = delimiter
                return i + 1
        return len(lines)


def _data_lines(lines: DataFrame, names: tuple[str, ...], skip_rows: int | None) -> DataFrame:
    """The lines behind each file's header, with the file's delimiter; null in later splits of a file."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _FileState(names, skip_rows)
        for batch in batches:
            paths = batch.column("path")
            at = 0
            while at < batch.num_rows:
                path = paths[at].as_py()
                end = at + 1
                # The lines of a file are neighbours: find the end of the run by halving.
                step = batch.num_rows - at
                while step:
                    if end + step <= batch.num_rows and paths[end + step - 1].as_py() == path:
                        end += step
                    else:
                        step //= 2
                if path != state.path:
                    state.enter(path)
                if state.delimiter is None:
                    at += state.rows_before_data(batch.column("value").slice(at, end - at).to_pylist())
                if at < end:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("value").slice(at, end - at), pa.array([state.delimiter] * (end - at), pa.string())],
                        names=["value", "delimiter"])
                at = end
        state.leave()

    start = F.col("_metadata.file_block_start")
    first = lines.where(start == 0).select("value", F.col("_metadata.file_path").alias("path"))
    later = lines.where(start != 0).select("value", F.lit(None).cast("string").alias("delimiter"))
    return first.mapInArrow(cut, "value string, delimiter string").unionByName(later)


def _width(value: Column, delimiter: str) -> Column:
    return F.size(F.split(value, delimiter if delimiter == "\t" else f"[{delimiter}]"))


def _cells(value: Column, names: Sequence[str], delimiter: str) -> Column:
    """The cells of a line: a short row is filled with missing cells, a long one is an error."""
    ddl = ", ".join(f"{n} string" for n in (*names, _BAD))
    row = F.from_csv(value, ddl, {"sep": delimiter, "columnNameOfCorruptRecord": _BAD})
    message = F.concat(F.lit("too many fields: "), F.substring(value, 1, 80))
    return F.when(row[_BAD].isNotNull() & (_width(value, delimiter) > len(names)), F.raise_error(message).cast(_struct(names))).otherwise(
        F.struct(*(row[n].alias(n) for n in names)))


def _struct(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_preamble_text(spark: SparkSession, path: str, skip_rows: int | None = None) -> DataFrame:
    """All cells as text, columns named by the header; every file under the path is read.

    Files may differ in preamble and delimiter, not in columns. The head of one file gives
    the columns; the others are checked while they are read. The header has to lie in the
    first split of its file (``spark.sql.files.maxPartitionBytes``). Blank lines are no rows.
    """
    files = list_files(spark, path)
    if not files:
        raise ValueError(f"no data files in {path}")
    head = find_header(spark, files[0], skip_rows)
    lines = _data_lines(spark.read.text(path), head.names, skip_rows).where(F.trim("value") != "")
    names = [f"c{i}" for i in range(len(head.names))]
    value = F.col("value")
    others = [d for d in _DELIMITERS if d != head.delimiter]
    # A later split does not know its file's delimiter. It takes that of the first file, and
    # a line with more cells under another one is an error: no such line is guessed at.
    foreign = F.col("delimiter").isNull() & (
        F.greatest(*(_width(value, d) for d in others)) > _width(value, head.delimiter))
    wrong = F.raise_error(F.concat(F.lit("a large file has another delimiter than the first one: "), F.substring(value, 1, 80)))
    cells = F.when(foreign, wrong.cast(_struct(names))).otherwise(_cells(value, names, head.delimiter))
    for delimiter in others:
        cells = F.when(F.col("delimiter") == delimiter, _cells(value, names, delimiter)).otherwise(cells)
    rows = lines.select(cells.alias("r")).select(*(F.col(f"r.{n}") for n in names))
    return trim_column_names(rows.toDF(*head.names))


def read_sensor_file(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = S.INGEST_NA_TOKENS, check_rows: bool = True,
) -> DataFrame:
    """Raw sensor files as a typed frame: class text, every sensor double, null for missing.

    A missing path, a missing header and a file set without rows are errors.
    """
    df = to_numeric(nullify_tokens(read_preamble_text(spark, path), na_tokens))
    if check_rows and df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_skip_rows(
    spark: SparkSession, path: str, skip_rows: int = S.PREAMBLE_LINES,
    na_tokens: Sequence[str] = S.STRICT_NA_TOKENS + S.COMMON_NA_TOKENS,
) -> DataFrame:
    """The same for files with a fixed number of lines before the header, whatever they hold."""
    return to_numeric(nullify_tokens(read_preamble_text(spark, path, skip_rows), na_tokens))


def write_preamble_csv(df: DataFrame, path: str, preamble: Sequence[str], files: int, delimiter: str = ",") -> None:
    """Text files that each start with the preamble and the header (fixtures, exports).

    One task writes one file: the lines before the data first, then its rows as they come.
    Nothing is sorted, so a task holds a batch of lines, however long its file is.
    """
    # Copies of a row go round over the files like any other rows.
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    body = df.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int").alias("file"), F.concat_ws(delimiter, *cells).alias("value"))
    head_lines = [*preamble, delimiter.join(df.columns)]

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(head_lines, pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).drop_null()], names=["value"])

    # A null per file: one without rows has its head too.
    marks = df.sparkSession.range(files).select(F.col("id").cast("int").alias("file"), F.lit(None).cast("string").alias("value"))
    lines = marks.unionByName(body).repartitionById(files, F.col("file")).select("value").mapInArrow(headed, "value string")
    lines.write.mode("overwrite").text(path)
