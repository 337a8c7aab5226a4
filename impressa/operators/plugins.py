"""Feature plug-ins as pyspark.ml stages: fitted on train, out of fold there, blind to the labels elsewhere, saved and loaded.

A plug-in is an Estimator with ``needs()``, the columns it reads; its model has
``transform``, and ``transform_train`` where rows of train must not see their
own label.  ``apply`` reads no other columns of a plug-in's input and checks that
it keeps the rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.operators import features
from impressa.sources.shared import cut


class _TableWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind(self.sparkSession.read.parquet(f"{path}/table"))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


class TableModel(Model, MLWritable, MLReadable):
    """A model that is a table."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _Encoding(Params):
    field = Param(Params._dummy(), "field", "column whose values are encoded", TypeConverters.toString)
    output = Param(Params._dummy(), "output", "new column", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "rows of the mean that each value is given", TypeConverters.toFloat)
    folds = Param(Params._dummy(), "folds", "parts of train", TypeConverters.toInt)
    rowId = Param(Params._dummy(), "rowId", "identifier of rows, by whose hash train is cut to folds", TypeConverters.toString)

    def needs(self) -> list[str]:
        return [self.getOrDefault(self.field)]


class TargetEncoder(Estimator, _Encoding, DefaultParamsWritable, DefaultParamsReadable):
    """Smoothed mean label of a value."""

    @keyword_only
    def __init__(self, *, field=None, output="encoding", smoothing=20.0, folds=5, rowId="row_id"):
        super().__init__()
        self._setDefault(output="encoding", smoothing=20.0, folds=5, rowId="row_id")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, train: DataFrame) -> TargetEncoderModel:
        field = self.getOrDefault(self.field)
        per = train.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
        whole = train.agg(F.lit(None).cast("string").alias("value"), F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
        return self._copyValues(TargetEncoderModel(cut(per.unionByName(whole))))


class TargetEncoderModel(TableModel, _Encoding):
    """(value, s, n): label sum and rows of each value, and of all under null."""

    def _names(self):
        return self.getOrDefault(self.field), self.getOrDefault(self.output), self.getOrDefault(self.smoothing)

    def _transform(self, rows: DataFrame) -> DataFrame:
        field, output, smoothing = self._names()
        mean = self.table.where("value is null").select((F.col("s") / F.col("n")).alias("_g"))
        known = self.table.where("value is not null").select(F.col("value").alias("_v"), F.col("s").alias("_s"), F.col("n").alias("_n"))
        joined = rows.join(known, F.col(field).cast("string") == F.col("_v"), "left").crossJoin(F.broadcast(mean))
        return joined.withColumn(output, F.coalesce((F.col("_s") + smoothing * F.col("_g")) / (F.col("_n") + smoothing), F.col("_g"))).drop("_v", "_s", "_n", "_g")

    def transform_train(self, train: DataFrame) -> DataFrame:
        """train encoded from the other folds."""
        field, output, smoothing = self._names()
        fold = F.pmod(F.xxhash64(self.getOrDefault(self.rowId)), F.lit(self.getOrDefault(self.folds)))
        return features.target_encoding_oof(train, field, fold, smoothing).withColumnRenamed("encoding", output)


class FrequencyEncoder(Estimator, _Encoding, DefaultParamsWritable, DefaultParamsReadable):
    """Rows of train that have the value."""

    @keyword_only
    def __init__(self, *, field=None, output="frequency"):
        super().__init__()
        self._setDefault(output="frequency")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, train: DataFrame) -> FrequencyEncoderModel:
        per = train.where(F.col(self.getOrDefault(self.field)).isNotNull()).groupBy(F.col(self.getOrDefault(self.field)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return self._copyValues(FrequencyEncoderModel(cut(per)))


class FrequencyEncoderModel(TableModel, _Encoding):
    """(value, n)"""

    def _transform(self, rows: DataFrame) -> DataFrame:
        known = self.table.select(F.col("value").alias("_v"), F.col("n").alias("_n"))
        return rows.join(known, F.col(self.getOrDefault(self.field)).cast("string") == F.col("_v"), "left").withColumn(self.getOrDefault(self.output), F.coalesce("_n", F.lit(0))).drop("_v", "_n")


def blind(model, rows: DataFrame, needs: list[str], row_id: str = "row_id", label: str = "label") -> DataFrame:
    """rows with the new columns of the model, which sees ``row_id`` and the columns it needs, never the label.

    The identifiers that come out must be those that went in, each as often.
    """
    given = rows.select(row_id, *[c for c in dict.fromkeys(needs) if c not in (row_id, label)])
    out = model.transform(given)
    new = [c for c in out.columns if c not in given.columns]
    here = rows.groupBy(row_id).agg(F.count(F.lit(1)).alias("_rows")).withColumnRenamed(row_id, "_id")
    made = out.groupBy(row_id).agg(F.count(F.lit(1)).alias("_made"), *[F.first(c).alias(c) for c in new])
    both = cut(here.join(made, F.col("_id").eqNullSafe(F.col(row_id)), "full"))
    bad = both.where(~F.col("_rows").eqNullSafe(F.col("_made"))).limit(1).collect()
    if bad:
        raise ValueError(f"a feature op must keep the rows: {row_id} {bad[0]['_id'] if bad[0]['_id'] is not None else bad[0][row_id]} came {bad[0]['_made'] or 0} times and not {bad[0]['_rows'] or 0}")
    both = both.select("_id", *new)
    return rows.join(both, F.col(row_id).eqNullSafe(F.col("_id"))).drop("_id")


def apply(ops: list[Estimator], train: DataFrame, others: list[DataFrame], row_id: str = "row_id", label: str = "label"):
    """(train and others with the new columns, the columns, the fitted models): fitted on train alone, one after the other."""
    before, models = set(train.columns), []
    for op in ops:
        needs = op.needs()
        given = train.select(*dict.fromkeys([row_id, label, *needs]))
        model = op.fit(given)
        models.append(model)
        others = [blind(model, rows, needs, row_id, label) for rows in others]
        train = model.transform_train(train) if hasattr(model, "transform_train") else blind(model, train, needs, row_id, label)
    return train, others, [c for c in train.columns if c not in before], models
