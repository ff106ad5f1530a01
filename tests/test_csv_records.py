"""CSV records over lines: any split of the file into tasks gives the records that a whole-file parser finds."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from featpipe.sources import files, records

COLUMNS = "k INT, a STRING, b STRING"


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)

    def to(n):
        spark.conf.set(key, str(n))

    yield to
    spark.conf.set(key, old)


def _random_rows(n, seed):
    r = random.Random(seed)
    bits = ["x", "yy", ",", '"', "\n", "\n\n", "\r\n", " ", "é", "a longer stretch of words "]
    return [(i, "".join(r.choice(bits) for _ in range(r.randint(1, 8))) + "v", "".join(r.choice(bits) for _ in range(r.randint(1, 30))) + "w")
            for i in range(n)]


def _csv(rows, newline="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=newline).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("split", "newline"), [(64, "\n"), (300, "\r\n"), (5000, "\n"), (10**7, "\n")])
def test_quoted_line_breaks_at_any_split(spark, tmp_path, small_splits, split, newline):
    want = []
    for f in range(2):  # states do not run from file to file
        rows = [(f * 1000 + k, a, b) for k, a, b in _random_rows(150, f)]
        want += rows
        with open(tmp_path / f"{f}.csv", "w", newline="") as out:
            out.write(_csv([("k", "a", "b"), *rows], newline))
    small_splits(split)
    df = files.read_csv(spark, str(tmp_path), columns=COLUMNS, header=True)
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(want)
    if split < 1000:
        assert records.lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
    assert df.count() == len(want)
    assert files.malformed_rows(spark, str(tmp_path), COLUMNS, header=True).first() == (0, len(want))


def test_records_that_span_many_splits(spark, tmp_path, small_splits):
    rows = [(1, "one", "two"), (2, "line\n" * 500, "z"), (3, 'say "hi",\n' * 300, "a\nb"), (4, "x", "y")]
    (tmp_path / "long.csv").write_text(_csv(rows))
    small_splits(100)
    got = files.read_csv(spark, str(tmp_path / "long.csv"), columns=COLUMNS)
    assert sorted(map(tuple, got.collect())) == rows
    assert [r.k for r in got.select("k").orderBy("k").collect()] == [1, 2, 3, 4]


def test_split_table_joined_by_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    rows = _random_rows(120, 9)
    (tmp_path / "a.csv").write_text(_csv(rows), newline="")
    small_splits(150)
    monkeypatch.setattr(records, "SPLITS_SENT", 0)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "a.csv"), columns=COLUMNS).collect())) == rows


def test_skip_and_header_before_quoted_records(spark, tmp_path, small_splits):
    text = 'an export, "not closed\nby hand\n' + _csv([("k", "a\nheading", "b"), *(rows := _random_rows(60, 4))])
    (tmp_path / "s.csv").write_text(text, newline="")
    for split in (40, 10_000):
        small_splits(split)
        got = files.read_csv(spark, str(tmp_path / "s.csv"), columns=COLUMNS, header=True, skip=2)
        assert sorted(map(tuple, got.collect())) == rows


def test_malformed_records_are_counted_as_records(spark, tmp_path):
    (tmp_path / "m.csv").write_text('1,"a\nb",x\nbad,"c\n\nd",y\n3,e,z\n')
    assert files.malformed_rows(spark, str(tmp_path / "m.csv"), COLUMNS).first() == (1, 3)
    kept = files.read_csv(spark, str(tmp_path / "m.csv"), columns=COLUMNS, ignore_errors=True)
    assert sorted(map(tuple, kept.collect())) == [(1, "a\nb", "x"), (3, "e", "z")]


def test_quotes_inside_plain_fields_and_other_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('1,5" pipe,x\n2,"two\nlines",y\n3,6" pipe,z\n')
    got = files.read_csv(spark, str(tmp_path / "q.csv"), columns=COLUMNS)
    assert sorted(map(tuple, got.collect())) == [(1, '5" pipe', "x"), (2, "two\nlines", "y"), (3, '6" pipe', "z")]
    (tmp_path / "e.csv").write_text("1|'it\\'s\nhere'|x\n2|plain|y\n")
    got = files.read_csv(spark, str(tmp_path / "e.csv"), columns=COLUMNS, delim="|", quote="'", escape="\\")
    assert sorted(map(tuple, got.collect())) == [(1, "it's\nhere", "x"), (2, "plain", "y")]


def test_plain_files_keep_the_pruned_scan(spark, tmp_path):
    (tmp_path / "p.csv").write_text('1,"a",x\n2,b,"y"\n')
    df = files.read_csv(spark, str(tmp_path / "p.csv"), columns=COLUMNS).select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "ReadSchema: struct<k:int>" in plan


def test_dialect_and_types_over_all_files(spark, tmp_path):
    # the first file has one column of empty values, and looks like comma-separated prose
    (tmp_path / "a.csv").write_text("id|when|note|amount|flag|big|day\n1||well, then||true|1|2024-01-02\n2||so, it goes||false|2|2024-01-03\n")
    (tmp_path / "b.csv").write_text(
        "id|when|note|amount|flag|big|day\n3|2024-05-01 10:00:00|'two\nlines'|1.5|TRUE|3000000000|2024-01-04\n4|2024-05-02|plain|2||4|\n")
    df = files.read_csv_auto(spark, str(tmp_path))
    assert df.dtypes == [("id", "int"), ("when", "timestamp"), ("note", "string"), ("amount", "double"), ("flag", "boolean"), ("big", "bigint"),
                         ("day", "date")]
    assert df.count() == 4 and df.where("note = 'two\nlines'").count() == 1
    assert df.agg(F.sum("amount"), F.sum("big")).first() == (3.5, 3000000007)
    assert files.sniff_dialect(spark, str(tmp_path)) == records.Dialect("|", "'")


def test_names_of_odd_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text('a,,a,"b\nc"\n1,2,3,4\n')
    assert files.read_csv_auto(spark, str(tmp_path / "n.csv")).dtypes == [("a", "int"), ("column1", "int"), ("a_1", "int"), ("b\nc", "int")]
    (tmp_path / "e.csv").write_text("")
    assert files.read_csv_auto(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "h.csv").write_text("1;2\n3;4\n")
    df = files.read_csv_auto(spark, str(tmp_path / "h.csv"), header=False)
    assert df.columns == ["column0", "column1"] and df.count() == 2
