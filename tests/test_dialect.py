"""DuckDB forms in step SQL: table functions, DOW, USING SAMPLE, TEXT casts, hash()."""

import pytest

from featpipe.plans.dialect import DialectError, translate
from featpipe.plans.steps import StepRunner, StepSpec


def test_text_forms():
    assert translate("SELECT CAST(a AS TEXT) FROM t;") == "SELECT CAST(a AS STRING) FROM t"
    assert translate("SELECT EXTRACT(DOW FROM ts) AS d FROM t") == "SELECT (EXTRACT(DOW FROM ts) - 1) AS d FROM t"
    assert translate("SELECT EXTRACT(HOUR FROM ts) FROM t") == "SELECT EXTRACT(HOUR FROM ts) FROM t"
    assert translate('SELECT * FROM "events" USING SAMPLE 10%') == 'SELECT * FROM "events" TABLESAMPLE (10 PERCENT)'
    assert "_fp_src_check" in translate("SELECT * FROM read_parquet('a/*.parquet') WHERE x > 1")
    assert translate("SELECT hash(id) % 10 FROM t") == "SELECT (shiftrightunsigned(xxhash64(id), 1)) % 10 FROM t"
    assert translate("SELECT body AS text, 'x AS TEXT, hash(1)' AS s FROM t") == "SELECT body AS text, 'x AS TEXT, hash(1)' AS s FROM t"
    assert translate("SELECT CAST(CAST(a AS INT) AS TEXT) AS text") == "SELECT CAST(CAST(a AS INT) AS STRING) AS text"
    with pytest.raises(DialectError):
        translate("SELECT * FROM read_csv('a', 5)")
    assert "xxhash64(id)" in translate("SELECT xxhash64(id) FROM t")


def test_pipeline_reads_files_through_table_functions(spark, tmp_path):
    csv = tmp_path / "people.csv"
    csv.write_text("id,name,age\n1,ann,30\n2,bob,0\n3,cy,41\n")
    dat = tmp_path / "ratings.dat"
    dat.write_text("1::10::4.5\n2::20::3.0\n1::20::2.0\n")
    js = tmp_path / "tags.json"
    js.write_text('[{"id": 1, "tag": "a"}, {"id": 3, "tag": "c"}]')
    pq = str(tmp_path / "pq")
    spark.range(1, 4).selectExpr("id", "id * 2 AS score").write.parquet(pq)
    spec = StepSpec.from_dict({"name": "load", "steps": [
        {"name": "people", "type": "table",
         "sql": f"SELECT id, name, CASE WHEN age = 0 THEN NULL ELSE age END AS age FROM read_csv_auto('{csv}')"},
        {"name": "ratings", "type": "view",
         "sql": f"SELECT column0 AS user_id, column2 AS rating FROM read_csv('{dat}', delim='::', header=false, "
                "columns={'column0': 'INTEGER', 'column1': 'INTEGER', 'column2': 'DOUBLE'})"},
        {"name": "joined", "type": "view", "depends_on": ["people", "ratings"],
         "sql": f"""SELECT p.id, p.name, AVG(r.rating) AS avg_rating, MAX(s.score) AS score, MAX(t.tag) AS tag
                    FROM "people" p
                    LEFT JOIN "ratings" r ON r.user_id = p.id
                    LEFT JOIN read_parquet('{pq}') s ON s.id = p.id
                    LEFT JOIN read_json_auto('{js}', format='array') t ON t.id = p.id
                    GROUP BY p.id, p.name"""}],
        "outputs": ["joined", "people"]})
    rep, out = StepRunner(spark, table_root=str(tmp_path / "tables")).run(spec)
    assert rep.ok, rep.error
    rows = sorted(tuple(r) for r in out["joined"].collect())
    assert rows == [(1, "ann", 3.25, 2, "a"), (2, "bob", 3.0, 4, None), (3, "cy", None, 6, "c")]
    assert [r.age for r in out["people"].orderBy("id").collect()] == [30, None, 41]


def test_documented_hash_split_runs(spark, tmp_path):
    spark.range(2000).selectExpr("id AS user_id", "id % 50 AS movie_id").createOrReplaceTempView("dial_events")
    spec = StepSpec.from_dict({"name": "h", "steps": [
        {"name": "train", "type": "view", "sql": "SELECT * FROM dial_events WHERE hash(user_id) % 10 < 8"},
        {"name": "test", "type": "view", "sql": "SELECT * FROM dial_events WHERE hash(user_id) % 10 >= 8"},
        {"name": "pair", "type": "view", "sql": "SELECT * FROM dial_events WHERE hash(user_id || movie_id) % 10 = 3"}],
        "outputs": ["train", "test", "pair"]})
    rep, out = StepRunner(spark, table_root=str(tmp_path / "t")).run(spec)
    assert rep.ok, rep.error
    n = out["train"].count()
    assert n + out["test"].count() == 2000 and 1500 < n < 1700
    assert out["train"].join(out["test"], "user_id").count() == 0 and 120 < out["pair"].count() < 280


def test_file_lists_and_sniffing(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("id\tv\n1\tx\n")
    b.write_text("id\tv\n2\ty\n")
    ja, jb = tmp_path / "a.json", tmp_path / "b.json"
    ja.write_text('{"id": 1}\n')
    jb.write_text('{"id": 2}\n')
    arr = tmp_path / "arr.json"
    arr.write_text('[\n {"id": 7},\n {"id": 8}]\n')
    from featpipe.plans.gate import query

    got = query(spark, f"SELECT id, v FROM read_csv_auto(['{a}', '{b}'], header=true) ORDER BY id")
    assert [tuple(r) for r in got.collect()] == [(1, "x"), (2, "y")]
    got = query(spark, f"SELECT id FROM read_csv(['{a}', '{b}'], delim='\t', header=true, columns={{'id': 'INTEGER', 'v': 'TEXT'}})")
    assert sorted(r.id for r in got.collect()) == [1, 2]
    assert query(spark, f"SELECT * FROM read_json(['{ja}', '{jb}'])").count() == 2
    assert query(spark, f"SELECT * FROM read_json_auto('{arr}')").count() == 2
    assert [r.col_name for r in query(spark, f"DESCRIBE SELECT * FROM read_csv_auto('{a}')").collect()] == ["id", "v"]
    assert query(spark, f'SELECT "id" FROM read_csv_auto(\'{a}\')').first()[0] == 1


@pytest.mark.parametrize("sql", [
    "SELECT 'FROM t USING SAMPLE 10%' AS s", "SELECT 'see read_csv(x) there' AS s", "SELECT \"read_csv(x)\" FROM t", "SELECT `hash(a)` FROM t",
    "SELECT 'it''s; CAST(a AS TEXT)' AS s", "SELECT 1 -- hash(a), don't\nFROM t", "SELECT 1 /* 'EXTRACT(DOW FROM a) /* hash(b) */ */ FROM t",
    "SELECT $$read_csv('a') isn't$$ AS s", "SELECT x.hash(1), text, a AS text FROM t", "SELECT hash FROM t", "SELECT 1 FROM a JOIN b USING (sample)"])
def test_quoted_text_and_comments_are_left_alone(sql):
    assert translate(sql) == sql


def test_rewrites_beside_comments_and_quotes():
    assert translate("SELECT CAST(a AS TEXT) -- don't\nFROM t") == "SELECT CAST(a AS STRING) -- don't\nFROM t"
    assert translate("SELECT 'a;' ; -- last;\n;") == "SELECT 'a;'"
    assert translate("SELECT CAST('x AS TEXT' AS /* to */ TEXT)") == "SELECT CAST('x AS TEXT' AS /* to */ STRING)"
    assert translate("SELECT a::TEXT, text::INT FROM t") == "SELECT a::STRING, text::INT FROM t"
    assert translate("SELECT hash(hash(a), CAST(b AS TEXT)) FROM t") == (
        "SELECT (shiftrightunsigned(xxhash64((shiftrightunsigned(xxhash64(a), 1)), CAST(b AS STRING)), 1)) FROM t")
    assert translate("SELECT EXTRACT(dow FROM CAST(a AS TEXT)) FROM t") == "SELECT (EXTRACT(dow FROM CAST(a AS STRING)) - 1) FROM t"
    assert "_fp_src_check" in translate("SELECT * FROM read_csv('it''s).csv', delim=',', columns={'a': 'DECIMAL(10, 2)', b: 'TEXT'})")
    for bad in ("SELECT 'open", "SELECT /* open", "SELECT hash((a", 'SELECT "open'):
        with pytest.raises(DialectError):
            translate(bad)


def test_tokens_are_the_whole_text():
    from featpipe.plans.tokens import text, tokenise

    sql = "SELECT a.b, 1.5e-3, .5, 'x''y', \"q\"\"\", `z` /* a /* b */ */ -- c\nFROM t WHERE é >= $1 AND c = $t$ ' $t$;"
    assert text(tokenise(sql)) == sql
    assert [t.text for t in tokenise(sql) if t.kind == "string"] == ["'x''y'", "$t$ ' $t$"]


def test_gate_reads_tokens(spark):
    from featpipe.plans.gate import QueryRejected, check_read_only

    assert check_read_only("-- it's\nSELECT ';' AS a /* ; */;;") == "SELECT ';' AS a"
    assert check_read_only("SELECT '--' || \"a;b\" FROM t") == "SELECT '--' || \"a;b\" FROM t"
    for bad in ("SELECT 1; DROP TABLE t", "/* SELECT */ DELETE FROM t", " ; ", "SELECT 'open", "'SELECT' 1"):
        with pytest.raises(QueryRejected):
            check_read_only(bad)
