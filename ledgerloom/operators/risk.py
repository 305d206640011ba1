"""Risk models over interval rows, their curves and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT = 5
CLASSES = ("none", "payment", "close_no_payment")


def rates(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, support, n_payment, n_close and their rates: the empirical baseline."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == "payment").alias("n_payment"), F.count_if(F.col("label") == "close_no_payment").alias("n_close"))
    return out.withColumns({"p_payment": F.col("n_payment") / F.col("support"), "p_close": F.col("n_close") / F.col("support")})


def with_rates(rows: DataFrame, table: DataFrame, *keys: str, least: int = MIN_SUPPORT) -> DataFrame:
    """Adds p_payment, p_close and p_none; null (abstention) where a cell is unseen or thin."""
    thick = table.where(F.col("support") >= least).select(*keys, "p_payment", "p_close")
    return rows.join(thick, list(keys), "left").withColumn("p_none", 1 - F.col("p_payment") - F.col("p_close"))


def cumulative(probabilities: Column) -> Column:
    """array<struct<f_payment, f_close, s>> from an array of (p_payment, p_close, p_none) by interval.

    Probabilities that are negative or don't add up to 1 within 1e-6 are an error. A null array gives null.
    """
    start = F.struct(F.lit(0.0).alias("f_payment"), F.lit(0.0).alias("f_close"), F.lit(1.0).alias("s"), F.array().cast("array<struct<f_payment:double,f_close:double,s:double>>").alias("path"))

    def step(a: Column, p: Column) -> Column:
        bad = (F.least(p["p_payment"], p["p_close"], p["p_none"]) < 0) | (F.abs(p["p_payment"] + p["p_close"] + p["p_none"] - 1) > 1e-6)
        payment = F.when(bad, F.raise_error(F.lit("probabilities are negative or don't add up to 1")).cast("double")).otherwise(a["f_payment"] + a["s"] * p["p_payment"])
        close, s = a["f_close"] + a["s"] * p["p_close"], a["s"] * p["p_none"]
        point = F.struct(payment.alias("f_payment"), close.alias("f_close"), s.alias("s"))
        return F.struct(payment.alias("f_payment"), close.alias("f_close"), s.alias("s"), F.concat(a["path"], F.array(point)).alias("path"))

    return F.aggregate(probabilities, start, step)["path"]


def scores(rows: DataFrame, label: str = "label") -> DataFrame:
    """n, n_abstained, log_loss and brier of rows with p_none, p_payment and p_close; abstentions count but don't score."""
    p = {"none": F.col("p_none"), "payment": F.col("p_payment"), "close_no_payment": F.col("p_close")}
    hit = F.when(F.col(label) == "payment", p["payment"]).when(F.col(label) == "close_no_payment", p["close_no_payment"]).otherwise(p["none"])
    known = F.col(label).isin("payment", "close_no_payment")
    brier = sum((F.pow(v - F.when((F.col(label) == k) if k != "none" else ~known, 1.0).otherwise(0.0), F.lit(2.0)) for k, v in p.items()), F.lit(0.0))
    return rows.agg(F.count(hit).alias("n"), F.count_if(hit.isNull()).alias("n_abstained"), F.avg(-F.ln(F.greatest(hit, F.lit(1e-12)))).alias("log_loss"), F.avg(brier).alias("brier"))


def fit_multinomial(rows: DataFrame, features: list[str], label: str = "label", least: int = MIN_SUPPORT):
    """A scaler and a multinomial logistic regression with L2 weight 1/n, fitted on `rows`; None if a class has fewer than `least` rows.

    The scaler uses the population standard deviation of the training rows only.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    support = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    if min(support.get("payment", 0), support.get("close_no_payment", 0)) < least:
        return None
    moments = rows.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def prepare(df: DataFrame) -> DataFrame:
        scaled = df.select("*", *[((F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"] or 1.0)).alias(f"_ll_f_{c}") for c in features])
        return VectorAssembler(inputCols=[f"_ll_f_{c}" for c in features], outputCol="_ll_vector", handleInvalid="keep").transform(scaled).drop(*[f"_ll_f_{c}" for c in features])

    index = F.when(F.col(label) == "payment", 1.0).when(F.col(label) == "close_no_payment", 2.0).otherwise(0.0)
    model = LogisticRegression(featuresCol="_ll_vector", labelCol="_ll_y", family="multinomial", regParam=1.0 / sum(support.values()), elasticNetParam=0.0, standardization=False, maxIter=500, probabilityCol="_ll_p", rawPredictionCol="_ll_raw", predictionCol="_ll_hat").fit(prepare(rows).withColumn("_ll_y", index))

    def predict(df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = vector_to_array("_ll_p")
        return model.transform(prepare(df)).withColumns({"p_none": p[0], "p_payment": p[1], "p_close": p[2]}).drop("_ll_vector", "_ll_p", "_ll_raw", "_ll_hat")

    return predict
