"""Models as fit and predict over DataFrames: factorisation machine scores and the trainer protocol."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators import features, metrics
from impressa.sources.shared import cut


class FeatureOp(Protocol):
    """Feature plug-in: fit on train only; transform never sees the label."""

    def fit(self, train: DataFrame) -> None: ...
    def transform(self, rows: DataFrame) -> DataFrame: ...


class Trainer(Protocol):
    """Model plug-in: fit, then score any split by row_id."""

    def fit(self, train: DataFrame, valid: DataFrame, seed: int, config: dict): ...
    def predict(self, model, rows: DataFrame) -> DataFrame: ...


def transform_without_label(op: FeatureOp, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The op on rows without their label; the label is joined back, and the identifiers that come out must be those that went in."""
    out, own = op.transform(rows.drop("label")), rows.select(F.col(row_id).alias("_id"), "label")
    both = cut(out.join(own, F.col(row_id).eqNullSafe(F.col("_id")), "full").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.coalesce("_id", row_id)))))
    if not both.where(~F.col(row_id).eqNullSafe(F.col("_id")) | (F.col("_n") > 1)).isEmpty():
        raise ValueError("a feature op must keep the rows")
    return both.drop("_id", "_n")


class FrequencyOp:
    """The train count of a field's value, as a feature plug-in."""

    def __init__(self, field: str):
        self.field, self.train = field, None

    def fit(self, train: DataFrame) -> None:
        self.train = train.select(self.field)

    def transform(self, rows: DataFrame) -> DataFrame:
        return features.frequency(rows, self.train, self.field)


class FMTrainer:
    """Spark's factorisation machine over coded fields."""

    def __init__(self, fields: list[str]):
        self.fields = fields

    def _pipeline(self, train: DataFrame):
        encoder = OneHotEncoder(inputCols=self.fields, outputCols=[f"{f}_v" for f in self.fields], handleInvalid="keep").fit(train)
        return encoder, VectorAssembler(inputCols=[f"{f}_v" for f in self.fields], outputCol="features")

    def fit(self, train: DataFrame, valid: DataFrame | None, seed: int, config: dict):
        """The state after ``epochs``; with valid (coded, with user_id and row_id), the state of best primary on it.

        Spark's fit cannot be resumed, so states are taken at epochs / 1, 2, 4...
        from the smallest on, which costs less than two full fits in all; it
        stops after ``patience`` states without a gain.
        """
        encoder, assembler = self._pipeline(train)
        rows = assembler.transform(encoder.transform(train))
        steps = [config.get("epochs", 20)]
        while valid is not None and steps[0] > 1:
            steps.insert(0, steps[0] // 2)
        best, top, since = None, None, 0
        for epochs in steps:
            fm = FMClassifier(factorSize=config.get("factors", 8), maxIter=epochs, stepSize=config.get("lr", 0.05), regParam=config.get("l2", 1e-5), seed=seed)
            model = encoder, assembler, fm.fit(rows)
            if valid is None:
                return model
            primary = metrics.ranking_metrics(self.predict(model, valid)).first().primary_score
            if best is None or primary > top:
                best, top, since = model, primary, 0
            else:
                since += 1
                if since >= config.get("patience", 2):
                    break
        return best

    def predict(self, model, rows: DataFrame) -> DataFrame:
        encoder, assembler, fm = model
        return fm.transform(assembler.transform(encoder.transform(rows))).withColumn("score", vector_to_array("probability")[1]).drop("features", "probability", "rawPrediction", "prediction", *[f"{f}_v" for f in self.fields])
