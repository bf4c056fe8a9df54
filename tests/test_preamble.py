import os
import tempfile

import pytest

from faultline.sources import preamble

DOC = ["Data set of a truck fleet", "", "Columns, units and so on, see below", "   "]


def _write(lines, name="a.csv", folder=None):
    folder = folder or tempfile.mkdtemp(prefix="run-")
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return folder


def test_header_is_found_and_cells_typed(spark):
    folder = _write(DOC + [" class,aa_000, ab_000 ", "neg,1,na", "", "pos, 2.5 ,NaN", "neg,bad,4"])
    df = preamble.read_sensor_file(spark, folder)
    assert df.columns == ["class", "aa_000", "ab_000"]
    assert preamble.find_header_row(spark, folder + "/a.csv") == 4
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == 3 and set(rows) == {("neg", 1.0, None), ("pos", 2.5, None), ("neg", None, 4.0)}


@pytest.mark.parametrize("delimiter", [";", "\t"])
def test_other_delimiters(spark, delimiter):
    folder = _write(DOC + [delimiter.join(["class", "aa_000"]), delimiter.join(["pos", "7"])])
    assert [tuple(r) for r in preamble.read_sensor_file(spark, folder).collect()] == [("pos", 7.0)]


def test_two_files_with_different_preambles_and_delimiters(spark):
    folder = _write(DOC + ["class,aa_000", "neg,1"])
    _write(["Only one line"] + ["class;aa_000", "pos;2", "pos;3"], "b.csv", folder)
    rows = sorted(tuple(r) for r in preamble.read_sensor_file(spark, folder).collect())
    assert rows == [("neg", 1.0), ("pos", 2.0), ("pos", 3.0)]


def test_fixed_preamble_counts_lines(spark):
    folder = _write(["x"] * 20 + ["class,aa_000", "neg,na", "pos,5"])
    rows = {tuple(r) for r in preamble.read_skip_rows(spark, folder).collect()}
    assert rows == {("neg", None), ("pos", 5.0)}


def test_far_header(spark):
    folder = _write([f"line {i}" for i in range(700)] + ["class,aa_000", "neg,1"])
    assert preamble.find_header_row(spark, folder + "/a.csv") == 700
    assert preamble.read_sensor_file(spark, folder).count() == 1


def test_errors(spark):
    with pytest.raises(ValueError, match="no header"):
        preamble.read_sensor_file(spark, _write(["nothing", "here"]))
    folder = _write(["class,aa_000", "pos,1"])
    with pytest.raises(Exception, match="no header line found in the first split of .*b.csv"):
        preamble.read_sensor_file(spark, _write(["nothing", "here"], "b.csv", folder)).collect()
    folder = _write(["class,aa_000", "pos,1"])
    with pytest.raises(Exception, match="different columns"):
        preamble.read_sensor_file(spark, _write(["class,ab_000", "pos,1"], "b.csv", folder)).collect()
    with pytest.raises(ValueError, match="no rows"):
        preamble.read_sensor_file(spark, _write(["class,aa_000"]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        preamble.read_sensor_file(spark, "/tmp/run-no-such-folder/x")
    with pytest.raises(Exception, match="too many fields"):
        preamble.read_sensor_file(spark, _write(["class,aa_000", "pos,1,2"])).collect()


def test_short_row_is_padded(spark):
    folder = _write(["class,aa_000,ab_000", "pos,1"])
    assert [tuple(r) for r in preamble.read_sensor_file(spark, folder).collect()] == [("pos", 1.0, None)]


def test_written_files_read_back(spark):
    df = spark.createDataFrame([("neg", str(i)) for i in range(500)], "class string, aa_000 string")
    path = tempfile.mkdtemp(prefix="run-") + "/out"
    preamble.write_preamble_csv(df, path, DOC, 3)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 3
    back = preamble.read_sensor_file(spark, path)
    assert back.count() == 500 and back.agg({"aa_000": "sum"}).collect()[0][0] == sum(range(500))


def test_rows_equal_to_preamble_lines_are_kept(spark):
    """The header is passed by position: no row is dropped for what it holds."""
    folder = _write(["neg,bad,2", "pos,1,1", "class,aa_000,ab_000", "neg,bad,2", "pos,3,4", "pos,1,1", "neg,bad"])
    rows = sorted((tuple(r) for r in preamble.read_sensor_file(spark, folder).collect()), key=str)
    assert rows == sorted([("neg", None, 2.0), ("pos", 3.0, 4.0), ("pos", 1.0, 1.0), ("neg", None, None)], key=str)
    fixed = _write(["1,2", "class,x_000", "class,aa_000", "pos,5", "class,aa_000", "1,2"])
    rows = [tuple(r) for r in preamble.read_skip_rows(spark, fixed, 2).collect()]
    assert rows == [("pos", 5.0), ("class", None), ("1", 2.0)]


def test_large_files_are_read_by_several_tasks(spark):
    lines = [f"neg,{i}" for i in range(30_000)]
    folder = _write(DOC + ["class,aa_000"] + lines)
    _write(["class,aa_000"] + lines, "b.csv", folder)
    _write(["class;aa_000", "neg;-1"], "c.csv", folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = preamble.read_sensor_file(spark, folder)
        assert df.rdd.getNumPartitions() > 20
        total = df.agg({"aa_000": "sum", "class": "count"}).collect()[0]
        assert sorted(total) == [60_001, 2 * sum(range(30_000)) - 1]
        _write(["class;aa_000"] + [line.replace(",", ";") for line in lines], "d.csv", folder)
        with pytest.raises(Exception, match="another delimiter"):
            preamble.read_sensor_file(spark, folder).count()
            preamble.read_sensor_file(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    """A task streams its lines behind the head, and a file without rows still has its head."""
    from pyspark.sql import DataFrame

    def refused(self, *columns, **options):
        raise AssertionError("a task would hold its whole file")

    monkeypatch.setattr(DataFrame, "sortWithinPartitions", refused)
    columns = "class string, aa_000 string"
    df = spark.createDataFrame([("neg", "1"), ("pos", None)], columns).coalesce(1)
    for rows, name in ((df, "two"), (df.where("false"), "none")):
        path = str(tmp_path / name)
        preamble.write_preamble_csv(rows, path, DOC, 3)
        files = [r[0].split("\n") for r in spark.read.text(path, wholetext=True).collect()]
        assert len(files) == 3
        assert all(f[:len(DOC) + 1] == [*DOC, "class,aa_000"] for f in files)
        assert sorted(line for f in files for line in f[len(DOC) + 1:] if line) == (["neg,1", "pos,"] if name == "two" else [])
