"""The corpus pipeline's stages against brute force on a small table with planted cases, and the query registry."""

import hashlib
import os
import re
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from featpipe.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]


@pytest.fixture(scope="module")
def folder(spark, prose, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    clean = [(i, prose(90 + i, i)) for i in range(60)]
    exam = prose(40, 5000)
    near = clean[59][1].split()
    near[10], near[50] = "altered", "words"
    rows = clean + [(100, clean[0][1]), (101, " ".join(near)), (102, prose(60, 6000) + " " + exam), (103, "too short"),
                    (104, " ".join(w + "###" for w in prose(80, 6001).split())), (105, prose(80, 6002) + " nasty vile " + prose(9, 6003)),
                    (106, prose(70, 6004) + " write to joe.doe@mail.example.com or 10.20.30.40 " + prose(10, 6005)), (107, None), (108, "")]
    rows += [(200 + i, " ".join(w + "&&&" for w in prose(90 + 2 * i, 7000 + i).split())) for i in range(30)]
    rows += [(300 + i, prose(80 + 2 * i, 8000 + i) + " vile and nasty, " + prose(6, 8100 + i)) for i in range(30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(30)] + [(300 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, dict(rows)


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    d, texts = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = queries.decontaminate.stored(stage(spark, docs, d), "test")
        assert docs.columns == columns, name
        kept.append({r.doc_id: r for r in docs.collect()})
    quality, near, exams, private = kept
    assert set(quality) == {*range(60), 100, 101, 102, 106}
    assert set(quality) - set(near) == {100, 101} and set(near) - set(exams) == {102} and set(private) == set(exams)
    for i, r in private.items():
        if i == 106:
            assert "joe.doe" not in r.text and "10.20.30.40" not in r.text and re.search(r" \w+\.\w+@\w+\.\w+\.com or [\d.]+ ", r.text)
        else:
            assert r.text == texts[i]
        assert r.n_chars == len(r.text)
    last = {r.doc_id: r for r in corpus_pipeline.STAGES[4][1](spark, docs, d).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in private.items():
        ids = library.encode(r.text)
        assert last[i].n_tokens == len(ids) and last[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert last[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    whole = {r.doc_id: tuple(r) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == {i: tuple(r) for i, r in last.items()}


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    d, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_to_workers_are_bounded_by_bytes(spark):
    """A batch of long texts has a few MB, not 10,000 rows; what a session sets itself stays."""
    from featpipe.session import configure

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    try:
        spark.conf.unset(key)
        configure(spark)
        docs = spark.range(0, 6000, 1, 1).selectExpr("repeat('some text ', 300) AS text")
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 6000 and max(r["size"] for r in found) < 5 << 20
        spark.conf.set(key, "9m")
        configure(spark)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.set(key, before)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline", n)]
    assert sorted(names) == sorted([*queries.QUERIES, "pipeline"])
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_the_rest_does_without_these_folders(tmp_path):
    """The entry module imports and lists the other queries when the subpackage and the pipeline are not there."""
    for name in ("featpipe", "__spark_entry__.py"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "featpipe").mkdir()
    for name in os.listdir(os.path.join(ROOT, "featpipe")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(ROOT, "featpipe", name), tmp_path / "featpipe" / name)
    code = ("import sys; sys.path.insert(0, '.'); import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py');"
            " sys.path = [p for p in sys.path if not p.endswith('/repo')]; m = u.module_from_spec(s); s.loader.exec_module(m);"
            f" sys.path = [p for p in sys.path if p != {ROOT!r}]; q = m.queries(); assert q and not any(n.startswith('op') for n in q), list(q);"
            " assert set(m.oracle_sql()) <= set(q)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
