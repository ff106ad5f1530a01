"""Training by epochs and model graphs (TRN1, TRN2, SCR1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from featpipe.functions.columns import round_to
from featpipe.operators import evaluation, model_graph, training
from featpipe.queries import query
from featpipe.queries.q_metrics import MULTI_CTE, multi_preds
from featpipe.sources.tables import read_table

EPOCHS, RATE = 4, 0.5
_X = ["x_price", "x_day"]
_ORDERS_SQL = """x AS (SELECT o_totalprice / 100000.0 - 1.5 AS a,
             CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) / 1000.0 - 1.2 AS b,
             CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS label, o_totalprice / 50000.0 AS y, o_orderkey % 5 = 0 AS held FROM orders)"""


def _orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select((F.col("o_totalprice") / 100000.0 - 1.5).alias("x_price"), (day / 1000.0 - 1.2).alias("x_day"),
                    F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"), (F.col("o_totalprice") / 50000.0).alias("y"),
                    (F.col("o_orderkey") % 5 == 0).alias("held"))


def _epochs_sql(target: str, loss: str, slope: str, rate: float) -> str:
    """Gradient descent written out, one CTE a step; {z} is the model's output."""
    z = "(w0 * a + w1 * b + c)"
    steps = [f"WITH {_ORDERS_SQL}, s0 AS (SELECT 0.0 AS w0, 0.0 AS w1, 0.0 AS c)"]
    for k in range(1, EPOCHS + 1):
        g = slope.format(z=z, y=target)
        steps.append(f"""s{k} AS (SELECT any_value(w0) - {rate} * avg({g} * a) FILTER (NOT held) AS w0, any_value(w1) - {rate} * avg({g} * b) FILTER (NOT held) AS w1,
       any_value(c) - {rate} * avg({g}) FILTER (NOT held) AS c, avg({loss.format(z=z, y=target)}) FILTER (NOT held) AS train_loss FROM x, s{k - 1})""")
    rows = " UNION ALL ".join(f"""SELECT {k} AS epoch, round(any_value(train_loss), 9) AS train_loss, round(avg({loss.format(z=z, y=target)}) FILTER (held), 9) AS val_loss,
       round(any_value(w0), 9) AS w_price, round(any_value(w1), 9) AS w_day, round(any_value(c), 9) AS bias FROM x, s{k}""" for k in range(1, EPOCHS + 1))
    return ",\n".join(steps) + "\n" + rows


def _history(trained):
    w = F.col("params")
    return trained.history.select("epoch", round_to("train_loss", 9).alias("train_loss"), round_to("val_loss", 9).alias("val_loss"),
                                  *[round_to(w[k], 9).alias(n) for k, n in enumerate(("w_price", "w_day", "bias"))])


@query("trn1_logistic_epochs", "TRN1 TRN2", oracle=_epochs_sql(
    "label", "(greatest({z}, 0.0) - {z} * {y} + ln(1 + exp(-abs({z}))))", "(1.0 / (1.0 + exp(-{z})) - {y})", RATE))
def trn1_logistic_epochs(spark, sf_dir):
    """Weights, training loss and validation loss of every epoch of a logistic regression."""
    return _history(training.fit_epochs(_orders(spark, sf_dir), _X, "label", "bce", F.col("held"), EPOCHS, RATE))


@query("trn2_linear_epochs_resumed", "TRN1 TRN2", oracle=_epochs_sql("y", "(({z} - {y}) * ({z} - {y}))", "(2 * ({z} - {y}))", 0.05))
def trn2_linear_epochs_resumed(spark, sf_dir):
    """A linear regression that is stopped after two epochs and goes on from its folder."""
    from featpipe.sources.files import scratch_path

    run = scratch_path(spark, "training")
    data = _orders(spark, sf_dir)
    training.fit_epochs(data, _X, "y", "mse", F.col("held"), 2, 0.05, run_dir=run)
    return _history(training.fit_epochs(data, _X, "y", "mse", F.col("held"), EPOCHS, 0.05, run_dir=run))


def _graph():
    """Numbers and an embedded index meet in one hidden layer, which feeds two heads; one of them also sees the numbers directly."""
    table = [[k / 10, (k % 3) / 5] for k in range(5)]
    n = model_graph.Node
    return model_graph.Graph({"numbers": 2, "line": 1}, {
        "line_row": n("embedding", ["line"], {"table": table}),
        "both": n("concat", ["numbers", "line_row"]),
        "hidden": n("linear", ["both"], {"weight": [[0.5, -0.25], [1.0, 2.0], [-0.5, 0.75], [0.25, 0.5]], "bias": [0.1, -0.2]}),
        "active": n("relu", ["hidden"]),
        "logit": n("linear", ["active"], {"weight": [[0.8], [-0.6]], "bias": [0.05]}),
        "probability": n("sigmoid", ["logit"]),
        "skip": n("linear", ["numbers"], {"weight": [[0.5, 0.0], [0.0, -1.0]], "bias": [0.0, 0.0]}),
        "levels": n("add", ["active", "skip"])}, {"probability": "probability", "levels": "levels"})


@query("scr1_graph_two_outputs", "SCR1 SCR2 SCR7", oracle="""
WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 50.0 AS a, l_discount * 10.0 AS b,
       CASE WHEN l_linenumber <= 4 THEN l_linenumber / 10.0 ELSE 0.0 END AS e0,
       CASE WHEN l_linenumber <= 4 THEN (l_linenumber % 3) / 5.0 ELSE 0.0 END AS e1 FROM lineitem),
h AS (SELECT *, greatest(0.5 * a + b - 0.5 * e0 + 0.25 * e1 + 0.1, 0.0) AS r0,
             greatest(-0.25 * a + 2.0 * b + 0.75 * e0 + 0.5 * e1 - 0.2, 0.0) AS r1 FROM i)
SELECT l_returnflag, l_linenumber, COUNT(*) AS n, round(AVG(1.0 / (1.0 + exp(-(0.8 * r0 - 0.6 * r1 + 0.05)))), 9) AS probability,
       round(AVG(r0 + 0.5 * a), 9) AS level0, round(AVG(r1 - b), 9) AS level1 FROM h GROUP BY 1, 2
""")
def scr1_graph_two_outputs(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linenumber", (F.col("l_quantity") / 50.0).alias("quantity"), (F.col("l_discount") * 10.0).alias("discount"))
    s = model_graph.score_graph(li, _graph(), {"numbers": ["quantity", "discount"], "line": ["l_linenumber"]}, ["l_returnflag", "l_linenumber"])
    return s.groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").alias("n"), round_to(F.avg("pred_probability"), 9).alias("probability"),
        round_to(F.avg(F.col("pred_levels")[0]), 9).alias("level0"), round_to(F.avg(F.col("pred_levels")[1]), 9).alias("level1"))


_GAPS_SQL = """g AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS y,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('nan' AS DOUBLE) ELSE o_totalprice * 0.9 + o_custkey END AS p FROM orders)"""


@query("met16_regression_on_clean_rows", "MET16 MET5 MET6", oracle=f"""
WITH {_GAPS_SQL}, ok AS (SELECT * FROM g WHERE y IS NOT NULL AND p IS NOT NULL AND NOT isnan(p)),
m AS (SELECT avg((p - y) ** 2) AS mse, avg(abs(p - y)) AS mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*) + 1e-8) AS r2 FROM ok)
SELECT 'mse' AS name, round(mse, 2) AS value, false AS higher_is_better FROM m UNION ALL SELECT 'mae', round(mae, 6), false FROM m
UNION ALL SELECT 'rmse', round(sqrt(mse), 6), false FROM m UNION ALL SELECT 'r2', round(r2, 9), true FROM m
UNION ALL SELECT 'rows written', CAST(count(*) AS DOUBLE), NULL FROM ok
""")
def met16_regression_on_clean_rows(spark, sf_dir):
    """Labels and predictions with gaps: every metric and the prediction table over the same rows."""
    from featpipe.sources.files import scratch_path

    key, o = F.col("o_orderkey"), read_table(spark, sf_dir, "orders")
    p = F.when(key % 11 == 0, None).when(key % 13 == 0, float("nan")).otherwise(F.col("o_totalprice") * 0.9 + F.col("o_custkey"))
    path = scratch_path(spark, "regression_predictions")
    row = evaluation.evaluate(o.select(F.when(key % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("y"), p.alias("p")),
                              "regression", "y", "p", prediction_table=path)
    written = spark.read.parquet(path).where("prediction = p").agg(F.count("*").cast("double").alias("value")).select(
        F.lit("rows written").alias("name"), "value", F.lit(None).cast("boolean").alias("higher_is_better"))
    digits = F.when(F.col("name") == "mse", round_to("value", 2)).when(F.col("name") == "r2", round_to("value", 9)).otherwise(round_to("value", 6))
    return row.select("name", digits.alias("value"), "higher_is_better").unionByName(written)


@query("met16_multiclass_on_clean_rows", "MET16 MET2 MET3", oracle=f"""
WITH {MULTI_CTE}, ok AS (SELECT label, pred FROM multi WHERE vec_id % 3 <> 0 AND label IS NOT NULL),
k AS (SELECT greatest(max(label), max(pred)) + 1 AS k FROM ok),
c AS (SELECT c.c, count(*) FILTER (label = c.c AND pred = c.c)::DOUBLE AS tp, count(*) FILTER (pred = c.c)::DOUBLE AS np,
             count(*) FILTER (label = c.c)::DOUBLE AS s FROM ok, (SELECT unnest(range(10)) AS c) c GROUP BY c.c),
m AS (SELECT sum(tp) / (SELECT count(*) FROM ok) AS acc, sum(tp / (np + 1e-8)) / any_value(k) AS p, sum(tp / (s + 1e-8)) / any_value(k) AS r FROM c, k)
SELECT 'accuracy' AS name, round(acc, 9) AS value FROM m UNION ALL SELECT 'precision', round(p, 9) FROM m
UNION ALL SELECT 'recall', round(r, 9) FROM m UNION ALL SELECT 'f1', round(2 * p * r / (p + r + 1e-8), 9) FROM m
""")
def met16_multiclass_on_clean_rows(spark, sf_dir):
    preds = multi_preds(spark, sf_dir).withColumn("pred", F.when(F.col("vec_id") % 3 != 0, F.col("pred")))
    return evaluation.evaluate(preds, "multiclass", "label", "pred").select("name", round_to("value", 9).alias("value"))


