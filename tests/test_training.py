"""Training by epochs, and model graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featpipe.operators import evaluation, metrics, model_graph, scoring, training


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    y = ((x @ [1.5, -2.0, 0.5] + r.normal(size=400) * 0.5) > 0).astype(float)
    rows = [(float(a), float(b), float(c), float(t), int(a * 1e6) % 4 == 0) for (a, b, c), t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double, held boolean"), x, y, np.array([r[4] for r in rows])


def test_slopes_equal_differences():
    r = np.random.default_rng(0)
    for loss, k in (("mse", 1), ("huber", 1), ("bce", 1), ("cross_entropy", 3)):
        for activation in ("relu", "tanh"):
            stack = training.Stack((4, 5, k), activation)
            p, x = stack.start(3) + 0.01, r.normal(size=(6, 4))
            y = r.integers(0, 3 if k == 3 else 2, 6).astype(float)
            grad, _ = stack.sums(p, loss, x, y, 2.0, True)
            for i in range(0, stack.n_params, 7):
                up, down = p.copy(), p.copy()
                up[i], down[i] = p[i] + 1e-6, p[i] - 1e-6
                slope = (stack.sums(up, loss, x, y, 2.0, False)[1] - stack.sums(down, loss, x, y, 2.0, False)[1]) / 2e-6
                assert grad[i] == pytest.approx(slope, rel=1e-4, abs=1e-5)


def test_epochs_equal_a_plain_loop(spark, data):
    df, x, y, held = data
    got = training.fit_epochs(df, ["a", "b", "c"], "y", "bce", F.col("held"), epochs=3, learning_rate=0.5, momentum=0.9)
    w, v = np.zeros(4), np.zeros(4)
    one = np.c_[x, np.ones(len(x))]
    bce = lambda m: np.mean(np.maximum(one[m] @ w, 0) - one[m] @ w * y[m] + np.log1p(np.exp(-np.abs(one[m] @ w))))
    for r in got.history.orderBy("epoch").collect():
        assert r.train_loss == pytest.approx(bce(~held), rel=1e-9)
        v = one[~held].T @ (1 / (1 + np.exp(-one[~held] @ w)) - y[~held]) / (~held).sum() + 0.9 * v
        w = w - 0.5 * v
        assert r.params == pytest.approx(w.tolist(), rel=1e-9) and r.val_loss == pytest.approx(bce(held), rel=1e-9)
    assert got.epochs == 3 and not got.stopped_early
    assert got.model.apply(x[:5])[:, 0] == pytest.approx(1 / (1 + np.exp(-one[:5] @ w)))


def test_batches_hidden_layers_and_resume(spark, data, tmp_path):
    df, x, y, held = data
    how = dict(loss="bce", validation=F.col("held"), learning_rate=0.02, optimizer="adam", batches=3, hidden=[6], activation="tanh")
    whole = training.fit_epochs(df, ["a", "b", "c"], "y", epochs=4, **how)
    run = str(tmp_path / "run")
    assert training.fit_epochs(df, ["a", "b", "c"], "y", epochs=2, run_dir=run, **how).epochs == 2
    resumed = training.fit_epochs(df, ["a", "b", "c"], "y", epochs=4, run_dir=run, **how)
    a, b = ([tuple(r)[:3] for r in t.history.orderBy("epoch").collect()] for t in (whole, resumed))
    assert len(a) == 4 and np.allclose(np.array(a), np.array(b), rtol=1e-9)  # sums may be added in another order
    assert a[-1][1] < a[0][1]
    with pytest.raises(scoring.ScoringError, match="other settings"):
        training.fit_epochs(df, ["a", "b", "c"], "y", epochs=5, run_dir=run, **{**how, "learning_rate": 0.5})
    # the finished run is only read
    again = training.fit_epochs(df, ["a", "b", "c"], "y", epochs=4, run_dir=run, **how)
    assert again.history.count() == 4 and np.allclose(again.model.apply(x[:3]), resumed.model.apply(x[:3]))


def test_early_stop_returns_the_best_weights(spark, data):
    df, *_ = data
    got = training.fit_epochs(df, ["a", "b", "c"], "y", "mse", F.col("held"), epochs=30, learning_rate=1.5, patience=2)  # diverges
    h = got.history.orderBy("epoch").collect()
    best = min(h, key=lambda r: r.val_loss)
    assert got.stopped_early and got.epochs == len(h) == best.epoch + 2 and got.best_epoch == best.epoch
    assert got.model.layers[0][1].ravel().tolist() + got.model.layers[0][2].tolist() == pytest.approx(best.params)


def test_classes_and_odd_rows(spark):
    rows = [(float(k % 3), float(k % 3 == 1), float(k % 3)) for k in range(60)] + [(None, 1.0, 0.0), (float("nan"), 1.0, 0.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    with pytest.raises(scoring.ScoringError, match="3 rows"):
        training.fit_epochs(df, ["a", "b"], "y", "cross_entropy")
    got = training.fit_epochs(df, ["a", "b"], "y", "cross_entropy", epochs=15, learning_rate=2.0, optimizer="sgd", invalid="skip")
    p = got.model.apply(np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]]))
    assert p.argmax(1).tolist() == [0, 1, 2] and np.allclose(p.sum(1), 1)
    assert {r.val_loss for r in got.history.collect()} == {None}
    with pytest.raises(scoring.ScoringError, match="no rows"):
        training.fit_epochs(df.where("a < -99"), ["a", "b"], "y", "mse")
    with pytest.raises(scoring.ScoringError, match="not finite"):
        training.fit_epochs(df, ["a", "b"], "y", "mse", epochs=400, learning_rate=1e200, invalid="skip")


# ---------------------------------------------------------------- graphs

def _graph(**outputs):
    n = model_graph.Node
    return model_graph.Graph({"x": 2, "i": 1}, {
        "row": n("embedding", ["i"], {"table": [[1.0, 2.0], [3.0, 4.0]]}), "sum": n("add", ["row", "x"]), "joined": n("concat", ["sum", "x"]),
        "out": n("softmax", ["joined"]), "unused": n("linear", ["x"], {"weight": [[1.0]]})}, outputs or {"probs": "out", "sum": "sum"})


def test_graph_outputs_and_unknown_indexes(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 0), (2, None, 1.0, 1), (3, 0.0, 0.0, 7), (4, 0.0, 0.0, None)], "k int, a double, b double, i int")
    got = {r.k: r for r in model_graph.score_graph(df, _graph(), {"x": ["a", "b"], "i": ["i"]}, ["k"]).collect()}
    assert got[1].pred_sum == [1.5, 3.0] and got[2].pred_sum == [3.0, 5.0] and got[3].pred_sum == got[4].pred_sum == [0.0, 0.0]
    assert sum(got[1].pred_probs) == pytest.approx(1.0) and len(got[1].pred_probs) == 4
    one = model_graph.score_graph(df, _graph(), {"x": ["a", "b"], "i": ["i"]}, ["k"], outputs="")
    assert one.columns == ["k", "pred_probs"]
    array = df.select("k", F.array("a", "b").alias("v"), "i")
    same = model_graph.score_graph(array, _graph(), {"x": "v", "i": ["i"]}, ["k"], ["sum"]).collect()
    assert {r.k: r.pred_sum for r in same} == {k: r.pred_sum for k, r in got.items()}
    assert model_graph.score_graph(df.where("k > 9"), _graph(), {"x": ["a", "b"], "i": ["i"]}, ["k"]).count() == 0


def test_graph_errors(spark):
    n = model_graph.Node
    for nodes, outputs, said in (({"a": n("relu", ["b"]), "b": n("relu", ["a"])}, {"o": "a"}, "cycle"), ({"a": n("swish", ["x"])}, {"o": "a"}, "unknown operation"),
                                 ({"a": n("relu", ["z"])}, {"o": "a"}, "no nodes or inputs"), ({"a": n("add", ["x"])}, {"o": "a"}, "two or more"),
                                 ({"a": n("relu", ["x"])}, {"o": "q"}, "no node"), ({"a": n("relu", ["x"])}, {}, "no outputs")):
        with pytest.raises(scoring.ScoringError, match=said):
            model_graph.Graph({"x": 2}, nodes, outputs)
    df = spark.createDataFrame([(1, [1.0], 0)], "k int, v array<double>, i int")
    with pytest.raises(Exception, match="takes 2 values"):
        model_graph.score_graph(df, _graph(), {"x": "v", "i": ["i"]}, ["k"]).collect()
    with pytest.raises(scoring.ScoringError, match="bound to no columns"):
        model_graph.score_graph(df, _graph(), {"x": "v"}, ["k"])
    with pytest.raises(scoring.ScoringError, match="does not fit"):
        model_graph.score_graph(df, _graph(o="unused"), {"x": "v"}, ["k"])


def test_a_trained_stack_scores_as_a_graph(spark, data):
    df, x, *_ = data
    model = training.fit_epochs(df, ["a", "b", "c"], "y", "bce", epochs=2, hidden=[4]).model
    g = model_graph.Graph.from_dense(model, 3, "probability")
    got = [r.pred_probability for r in model_graph.score_graph(df, g, {"x": ["a", "b", "c"]}, ["y"]).collect()]
    assert got == pytest.approx(model.apply(x)[:, 0].tolist())


# ---------------------------------------------------------------- evaluations

def test_regression_metrics_share_their_rows(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.5), (None, 9.0), (4.0, None), (5.0, float("nan")), (float("inf"), 1.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r.n == 2 and r.mse == pytest.approx(0.25) and r.r2 == pytest.approx(1 - 0.5 / (0.5 + 1e-8))


def test_evaluations_need_valid_rows_and_write_them(spark, tmp_path):
    rows = [(float(k), float(k) + 1, k) for k in range(12)] + [(None, 1.0, 99)]
    df = spark.createDataFrame(rows, "y double, p double, k int")
    got = evaluation.evaluate(df, "regression", "y", "p", prediction_table=str(tmp_path / "t"))
    assert {r.name: r.value for r in got.collect()}["mae"] == pytest.approx(1.0)
    written = spark.read.parquet(str(tmp_path / "t"))
    assert written.count() == 12 and written.where("prediction <> p").count() == 0 and set(written.columns) == {"y", "p", "k", "prediction"}
    for task in ("regression", "multiclass"):
        with pytest.raises(ValueError, match="needs 1"):
            evaluation.evaluate(df.where("k = 99"), task, "y", "p")
