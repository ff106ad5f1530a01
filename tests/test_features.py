"""Feature operators on the reference tests' literal fixtures."""

import pytest
from pyspark.sql import functions as F

from featpipe.operators import features as FE
from featpipe.operators.feature_graph import FeaturePipeline, PipelineError, load_numeric_state, save_numeric_state


def test_sequence_shift_left_right(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([4, 5, 6],), ([],)], "a array<int>")
    rows = df.select(FE.sequence_shift("a", "left", 0).alias("l"), FE.sequence_shift("a", "right", 9).alias("r")).collect()
    assert [list(r["l"]) for r in rows] == [[2, 3, 0], [5, 6, 0], []]
    assert [list(r["r"]) for r in rows] == [[9, 1, 2], [9, 4, 5], []]


def test_hash_and_pad_strings(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "a array<string>")
    rows = [list(r[0]) for r in df.select(FE.hash_and_pad("a", 10, 4, 0, numeric=False, method="blake2b")).collect()]
    assert all(len(r) == 4 for r in rows)
    assert rows[1][1:] == [0, 0, 0] and rows[2] == [0, 0, 0, 0]
    assert all(0 <= v < 10 for r in rows for v in r)
    import hashlib

    exp_a = int.from_bytes(hashlib.blake2b(b"a", digest_size=8).digest(), "little") % 10
    assert rows[0][0] == exp_a


def test_hash_and_pad_truncates(spark):
    df = spark.createDataFrame([([11, 12, 13, 14, 15],)], "a array<bigint>")
    assert list(df.select(FE.hash_and_pad("a", 10, 3, 0)).first()[0]) == [1, 2, 3]


def test_label_encoder_cases(spark):
    df = spark.createDataFrame([(v,) for v in ["cat", "dog", "bird", "cat", "dog", "cat"]], "x string")
    vocab = FE.fit_label_encoder(df, "x", cut_lineage=False)
    got = {r["value"]: r["idx"] for r in vocab.frame.collect()}
    assert got == {"bird": 0, "cat": 1, "dog": 2} and vocab.size == 3
    # NULL is a category and sorts last
    dfn = spark.createDataFrame([("b",), (None,), ("a",)], "x string")
    vn = FE.fit_label_encoder(dfn, "x", cut_lineage=False)
    assert {r["value"]: r["idx"] for r in vn.frame.collect()} == {"a": 0, "b": 1, None: 2}
    # single value
    one = FE.fit_label_encoder(spark.createDataFrame([("z",), ("z",)], "x string"), "x", cut_lineage=False)
    assert one.size == 1
    # OOV default -> vocab size; explicit unknown_value; error mode
    new = spark.createDataFrame([("cat",), ("fish",), (None,)], "x string")
    enc = [r["x_idx"] for r in FE.label_encode(new, "x", vocab).orderBy(F.col("x").asc_nulls_last()).collect()]
    assert enc == [1, 3, 3]
    enc0 = FE.label_encode(new, "x", vocab, unknown_value=0).where("x = 'fish'").first()["x_idx"]
    assert enc0 == 0
    with pytest.raises(FE.FeatureError, match="'fish' was not seen"):
        FE.label_encode(new.where("x is not null"), "x", vocab, handle_unknown="error")
    # empty input
    empty = spark.createDataFrame([], "x string")
    assert FE.label_encode(empty, "x", vocab).count() == 0


def test_limited_vocabulary_unknown_zero(spark):
    train = spark.createDataFrame([("cat_a",), ("cat_b",)], "c string")
    v = FE.fit_label_encoder(train, "c", cut_lineage=False)
    test = spark.createDataFrame([("cat_c",)], "c string")
    assert FE.label_encode(test, "c", v, unknown_value=0).first()["c_idx"] == 0
    assert FE.label_encode(test, "c", v).first()["c_idx"] == 2


def test_one_hot_colours(spark):
    colours = "red green blue red green blue red green".split()
    df = spark.createDataFrame([(c,) for c in colours], "colour string")
    cats = FE.fit_categories(df, "colour")
    assert cats == ["blue", "green", "red"]
    out = FE.one_hot(df, "colour", cats, drop_input=True)
    assert out.columns == ["colour_blue", "colour_green", "colour_red"]
    assert out.agg(*[F.sum(c) for c in out.columns]).first()[:] == (2, 3, 3)
    unseen = spark.createDataFrame([("purple",)], "colour string")
    assert FE.one_hot(unseen, "colour", cats, drop_input=True).first()[:] == (0, 0, 0)
    with pytest.raises(FE.FeatureError):
        FE.one_hot(unseen, "colour", cats, handle_unknown="error")


PATIENTS = [(30, 22.5, 120.0, 0, "US"), (45, 27.1, 99.0, 1, "CA"), (52, 31.2, 150.0, 1, "US"), (28, 20.0, 85.0, 0, "FR")]
SPEC = {
    "ops": [
        {"op": "transform.assemble_vector", "inputs": {"columns": ["age", "bmi", "glucose_level"]}, "output": "tensors.x"},
        {"op": "fit.standard_scaler", "inputs": {"x": "tensors.x"}, "output": "states.scaler"},
        {"op": "transform.standard_scaler", "inputs": {"x": "tensors.x", "state": "states.scaler"},
         "output": "tensors.features"},
        {"op": "fit.label_encoder", "inputs": {"x": "country"}, "output": "states.country_vocab"},
        {"op": "transform.label_encode", "inputs": {"x": "country", "state": "states.country_vocab"},
         "output": "tensors.country_idx"},
    ],
    "outputs": ["tensors.features", "tensors.country_idx"],
}


def test_feature_pipeline_train_predict_parity(spark):
    df = spark.createDataFrame(PATIENTS, "age int, bmi double, glucose_level double, outcome int, country string")
    p = FeaturePipeline(SPEC)
    out, states, _ = p.run(df, training=True, keep=["age"])
    pred, _, _ = p.run(df, training=False, states=states, keep=["age"])
    a = sorted((r["age"], tuple(r["features"]), r["country_idx"]) for r in out.collect())
    b = sorted((r["age"], tuple(r["features"]), r["country_idx"]) for r in pred.collect())
    assert a == b
    col0 = [r["features"][0] for r in out.collect()]
    assert abs(sum(col0)) < 1e-9  # mean 0 on the training data


def test_prediction_without_state_fails(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "f1 double, f2 double")
    spec = {"ops": [
        {"op": "transform.assemble_vector", "inputs": {"columns": ["f1", "f2"]}, "output": "tensors.x"},
        {"op": "fit.standard_scaler", "inputs": {"x": "tensors.x"}, "output": "states.s"},
        {"op": "transform.standard_scaler", "inputs": {"x": "tensors.x", "state": "states.s"}, "output": "tensors.y"}],
        "outputs": ["tensors.y"]}
    with pytest.raises(PipelineError, match="missing"):
        FeaturePipeline(spec).run(df, training=False)


def test_scaler_rules_and_state_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (1.0, 7.0)], "a double, b double")
    st = FE.fit_standard_scaler(df, ["a", "b"])
    assert st["params"]["a"]["std"] == 1.0  # zero std becomes 1
    one = FE.fit_standard_scaler(df.limit(1), ["b"])
    assert one["params"]["b"]["std"] == 1.0  # one row: NULL std becomes 1
    mm = FE.fit_minmax(df, ["a"], (0.0, 1.0))
    assert mm["params"]["a"]["max"] == 2.0  # zero range becomes [min, min + 1]
    path = str(tmp_path / "state")
    save_numeric_state(spark, st, path)
    assert load_numeric_state(spark, path, "standard")["params"]["b"]["mean"] == 6.0
    with pytest.raises(PipelineError):
        load_numeric_state(spark, path, "minmax")


def test_exact_quantiles_linear_interpolation(spark):
    df = spark.createDataFrame([(float(x), "g") for x in range(10)], "v double, g string")
    q = FE.exact_quantiles(df, "v", [0.25, 0.5], ["g"], n_buckets=3).first()
    assert (q["q25"], q["q50"]) == (2.25, 4.5)


def test_target_encoding_smoothing(spark):
    train = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "c string, y int")
    enc = FE.fit_target_encoder(train, "c", "y", smoothing=1.0)
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    got = {r["c"]: r["c_te"] for r in FE.target_encode(test, enc).collect()}
    gm = 2 / 3
    assert abs(got["a"] - (2 * 1.0 + gm) / 3) < 1e-12 and abs(got["z"] - gm) < 1e-12


def test_vocabulary_save_load(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    v = FE.fit_label_encoder(df, "c", cut_lineage=False)
    FE.save_vocabulary(v, str(tmp_path / "vocab"))
    back = FE.load_vocabulary(spark, str(tmp_path / "vocab"), "c")
    assert back.size == 2 and {r["value"] for r in back.frame.collect()} == {"x", "y"}


def test_one_hot_sparse_unknown_is_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "x string")
    v = FE.fit_label_encoder(train, "x", include_null=False, cut_lineage=False)
    test = spark.createDataFrame([("a",), ("c",), ("zz",)], "x string")
    rows = {r["x"]: r["x_onehot"].toArray().tolist() for r in FE.one_hot_sparse(test, "x", v).collect()}
    assert rows == {"a": [1.0, 0.0, 0.0], "c": [0.0, 0.0, 1.0], "zz": [0.0, 0.0, 0.0]}


def test_exact_quantiles_keep_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    got = {r["g"]: r["q50"] for r in FE.exact_quantiles(df, "v", [0.5], ["g"], n_buckets=2).collect()}
    assert got == {"a": 2.0, None: 6.0}


def test_column_quantiles_many_columns_one_pass(spark):
    import pandas as pd

    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [10.0, 10.0, 20.0, 40.0, 50.0]})
    df = spark.createDataFrame(pdf)
    qs = FE.column_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75], ["q1", "med", "q3"])
    for c in ("a", "b"):
        s = pdf[c].dropna()
        assert (qs[c]["q1"], qs[c]["med"], qs[c]["q3"]) == (s.quantile(0.25), s.median(), s.quantile(0.75))
    st = FE.fit_robust(df, ["a", "b"])
    assert st["params"]["b"] == {"median": 20.0, "iqr": 30.0}


def test_fit_categories_many(spark):
    df = spark.createDataFrame([("red", "S"), ("blue", "M"), ("red", None), ("green", "S")], "colour string, size string")
    assert FE.fit_categories_many(df, ["colour", "size"]) == {"colour": ["blue", "green", "red"], "size": ["M", "S"]}
    with pytest.raises(FE.FeatureError, match="limit of 2"):
        FE.fit_categories_many(df, ["colour"], max_categories=2)


def test_feature_pipeline_batches_scaler_fits(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    spec = {"ops": [
        {"op": "fit.standard_scaler", "inputs": {"x": "a"}, "output": "states.sa"},
        {"op": "fit.standard_scaler", "inputs": {"x": "b"}, "output": "states.sb"},
        {"op": "transform.standard_scaler", "inputs": {"x": "a", "state": "states.sa"}, "output": "tensors.za"},
        {"op": "transform.standard_scaler", "inputs": {"x": "b", "state": "states.sb"}, "output": "tensors.zb"}],
        "outputs": ["tensors.za", "tensors.zb"]}
    out, states, _ = FeaturePipeline(spec).run(df)
    assert states["sa"]["mean"] == [2.0] and states["sb"]["mean"] == [20.0]
    assert sorted((round(r.za, 6), round(r.zb, 6)) for r in out.collect()) == [(-0.707107, -0.707107), (0.707107, 0.707107)]
