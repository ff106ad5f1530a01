"""File readers: CSV inference, declared schema, '::' delimiter, malformed rows, JSON forms,
hive-partitioned parquet."""

from pyspark.sql import functions as F

from featpipe.sources import files


def test_csv_auto_and_declared(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("id,name,score\n1,ann,2.5\n2,bob,3.0\n")
    auto = files.read_csv_auto(spark, str(p))
    assert dict(auto.dtypes) == {"id": "int", "name": "string", "score": "double"}
    dec = files.read_csv(spark, str(p), columns={"id": "BIGINT", "name": "VARCHAR", "score": "DOUBLE"}, header=True)
    assert dec.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and dec.count() == 2


def test_csv_double_colon_and_headerless_rename(spark, tmp_path):
    p = tmp_path / "r.dat"
    p.write_text("1::10::4.0::100\n2::20::3.5::200\n")
    df = files.read_csv(spark, str(p), columns="column0 INT, column1 INT, column2 DOUBLE, column3 BIGINT", delim="::",
                        names=["userId", "movieId", "rating", "timestamp"])
    assert df.columns == ["userId", "movieId", "rating", "timestamp"]
    assert df.agg(F.sum("rating")).first()[0] == 7.5


def test_csv_ignore_errors_drops_malformed(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("1,2.0\nx,3.0\n3,4.0\n")
    df = files.read_csv(spark, str(p), columns="a INT, b DOUBLE", ignore_errors=True)
    assert df.count() == 2 and df.select("b").count() == 2 and len(df.collect()) == 2


def test_csv_skip_lines(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("junk line\nmore junk\n1,a\n2,b\n")
    df = files.read_csv(spark, str(p), columns="n INT, s STRING", skip=2)
    assert sorted(r.n for r in df.collect()) == [1, 2]


def test_json_forms(spark, tmp_path):
    nd = tmp_path / "nd.json"
    nd.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    arr = tmp_path / "arr.json"
    arr.write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert files.read_json_auto(spark, str(nd)).count() == 2
    assert files.read_json_auto(spark, str(arr), format="array").count() == 2
    typed = files.read_json_auto(spark, str(nd), columns={"a": "INTEGER", "b": "VARCHAR"})
    assert typed.dtypes == [("a", "int"), ("b", "string")]


def test_parquet_hive_partitions_prune(spark, tmp_path):
    d = str(tmp_path / "pq")
    spark.range(20).selectExpr("id", "id % 2 AS year").write.partitionBy("year").parquet(d)
    df = files.read_parquet(spark, d).where("year = 1")
    assert df.count() == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "year" in plan


def test_csv_sniffed_delimiter(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("a|b|c\n1|2|x\n3|4|y\n")
    df = files.read_csv_auto(spark, str(p))
    assert df.columns == ["a", "b", "c"] and df.count() == 2


def test_csv_skip_with_header_and_many_files(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(3):
        (d / f"f{i}.csv").write_text(f"# export {i}\nid,name\n{i},n{i}\n{i + 10},m{i}\n")
    df = files.read_csv(spark, str(d), columns="id INT, name STRING", header=True, skip=1)
    assert sorted(r.id for r in df.collect()) == [0, 1, 2, 10, 11, 12]


def test_malformed_row_report(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("1,2.0\nx,3.0\n3,4.0\n4,zz\n")
    r = files.malformed_rows(spark, str(p), "a INT, b DOUBLE").first()
    assert (r["bad_rows"], r["total_rows"]) == (2, 4)
