"""Regression of future customer value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.columns import hash_bucket

FEATURES = ["frequency_cal", "recency_cal", "T_cal", "monetary_value", "f_sqrt", "f_log", "fm_log"]
#: The columns that are standardised; the derived ones stay as they are.
SCALED = FEATURES[:4]


def ml_features(pp: DataFrame) -> DataFrame:
    """MLR1: label ln((f_h+1)·m_h+1); features sqrt(f+1), ln(f+1), ln((f+1)·m+1)
    next to the raw summary columns."""
    f = F.col("frequency_cal").cast("double")
    m = F.col("monetary_value")
    return pp.select("id", f.alias("frequency_cal"), F.col("recency_cal").cast("double").alias("recency_cal"),
                     F.col("T_cal").cast("double").alias("T_cal"), "monetary_value",
                     F.sqrt(f + 1).alias("f_sqrt"), F.log(f + 1).alias("f_log"), F.log((f + 1) * m + 1).alias("fm_log"),
                     F.log((F.col("frequency_holdout") + 1) * F.col("money_holdout") + 1).alias("label"))


def split(df: DataFrame, train_share: float, id_col: str = "id") -> DataFrame:
    """MLR2: deterministic hash split, ``is_train``."""
    return df.withColumn("is_train", hash_bucket(id_col) < F.lit(int(round(train_share * 1000))))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """MLR3: (x − mean_train) / σ_train with the population σ, fitted on the
    train rows only (one aggregate row, broadcast)."""
    tr = df.where("is_train")
    stats = tr.agg(*[F.avg(c).alias("__m_" + c) for c in cols], *[F.stddev_pop(c).alias("__s_" + c) for c in cols])
    out = df.join(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col("__m_" + c), F.col("__s_" + c)))
    return out.drop(*["__m_" + c for c in cols], *["__s_" + c for c in cols])


def _fit(df: DataFrame, cols: list[str], alpha: float):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    tr = df.where("is_train")
    st = tr.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sy")).first()
    reg = alpha / st["n"] * st["sy"] if st["n"] else 0.0
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    lr = LinearRegression(featuresCol="features", labelCol="label", regParam=reg, elasticNetParam=0.0,
                          standardization=False, solver="normal")
    model = lr.fit(va.transform(tr))
    return model, va


def ridge_coefficients(df: DataFrame, cols: list[str], alpha: float = 0.5) -> DataFrame:
    """MLR4: Ridge(alpha) = Spark ``LinearRegression`` with
    regParam = alpha/n · σ_pop(y), no standardisation, normal equations."""
    model, _ = _fit(df, cols, alpha)
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients.toArray())] + [("intercept", float(model.intercept))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def ridge_mae(df: DataFrame, cols: list[str], alpha: float = 0.5) -> DataFrame:
    """MLR5: MAE on train and test rows."""
    model, va = _fit(df, cols, alpha)
    pred = model.transform(va.transform(df))
    return pred.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("part")).agg(
        F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"), F.count(F.lit(1)).alias("n"))
