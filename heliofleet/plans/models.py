"""Regressor registry, training and evaluation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts as C
from ..operators import evaluate, trees
from ..session import cut_lineage

FEATURES = "features"
RIDGE_ALPHA = 1.0


def ridge(train: DataFrame, label: str = C.TARGET, alpha: float = RIDGE_ALPHA) -> LinearRegression:
    """Closed-form L2 regression with an unpenalised intercept.

    Spark scales its penalty by the label's deviation and the row count; one aggregate over the
    training rows turns ``alpha`` into that scale.
    """
    row = train.agg(F.stddev_pop(label).alias("s"), F.count("*").alias("n")).first()
    reg = alpha * (row["s"] or 0.0) / max(row["n"], 1)
    return LinearRegression(featuresCol=FEATURES, labelCol=label, predictionCol="y_pred", solver="normal",
                            elasticNetParam=0.0, standardization=False, regParam=reg)


@dataclass(frozen=True)
class TreeRegressor:
    """Trees to be grown by ``operators.trees``; models of one fit are grown together."""

    spec: trees.Spec


class TreeModel(Model, MLWritable, MLReadable):
    """Fitted trees as a pipeline stage that adds ``y_pred``."""

    def __init__(self, ensemble: trees.Ensemble | None = None):
        super().__init__()
        self.ensemble = ensemble

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return trees.predict(dataset, {"y_pred": self.ensemble})

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.ensemble.importances())

    def write(self) -> MLWriter:
        return _TreeWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TreeReader()


_NODES = ("feature", "threshold", "left", "right", "value", "gain")


class _TreeWriter(MLWriter):
    def __init__(self, model: TreeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        e = self.model.ensemble
        nodes = pd.DataFrame({c: getattr(e, c) for c in _NODES}).reset_index(names="node")
        self.sparkSession.createDataFrame(nodes).write.parquet(f"{path}/nodes")
        head = [(json.dumps(asdict(e.spec)), e.features, float(e.base), e.starts.tolist())]
        self.sparkSession.createDataFrame(head, "spec string, features array<string>, base double, starts array<long>").write.parquet(f"{path}/head")


class _TreeReader(MLReader):
    def load(self, path: str) -> TreeModel:
        head = self.sparkSession.read.parquet(f"{path}/head").first()
        nodes = self.sparkSession.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
        model = TreeModel(trees.Ensemble(trees.Spec(**json.loads(head["spec"])), list(head["features"]), head["base"],
                                         *(nodes[c].to_numpy() for c in _NODES), np.array(head["starts"])))
        model._resetUid(DefaultParamsReader.loadMetadata(path, self.sparkSession)["uid"])
        return model


Factory = Callable[[DataFrame], Estimator | TreeRegressor]


def registry(label: str = C.TARGET, seed: int = 42, n_trees: int = 200, rounds: int = 300) -> dict[str, Factory]:
    """Name to factory of an estimator. Tree counts, rounds and shares are the full presets by default.

    Trees of the two forests grow until their leaves are pure. Boosting grows six levels, or up to 31 leaves with the largest gain first,
    or six symmetric levels (one split a level).
    """
    def grown(**kw) -> Factory:
        return lambda train: TreeRegressor(trees.Spec(seed=seed, **kw))

    boosted = {"trees": rounds, "boosted": True, "rate": 0.05, "row_share": 0.8}
    return {
        "ridge": lambda train: ridge(train, label),
        "random_forest": grown(trees=n_trees, bootstrap=True),
        "extra_trees": grown(trees=n_trees, random_cuts=True),
        "boosted_depth6": grown(**boosted, depth=6, l2=1.0, column_share=0.8),
        "boosted_31_leaves": grown(**boosted, growth="best_first", leaves=31, min_rows=20, column_share=0.8),
        "boosted_symmetric": grown(**boosted, growth="symmetric", depth=6, l2=3.0),
    }


def assembled(features: Sequence[str], estimator: Estimator, scale: bool = False) -> Pipeline:
    """Assemble the feature columns, optionally standardise (fitted on train only), then fit."""
    if not scale:
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol=FEATURES), estimator])
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True, withStd=True),
        estimator,
    ])


def _inputs(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Features for trees and for assembled vectors: a one-hot vector goes into the latter, its index into the former."""
    vectors = {f for f in features if df.schema[f].dataType.typeName() == "vectorudt"}
    indexes = {f.removesuffix("_vector") + "_index" for f in vectors}
    return [f for f in features if f not in vectors], [f for f in features if f not in indexes]


def fit_all(train: DataFrame, features: Sequence[str], factories: Mapping[str, Factory], label: str = C.TARGET,
            scale: bool = False, written: bool = False) -> dict[str, PipelineModel]:
    """Fit each model on the training rows, which are written once (unless they are already) and read by every fit."""
    rows = train.select(*features, label)
    rows = rows if written else cut_lineage(rows)
    made = {name: make(rows) for name, make in factories.items()}
    scalar, dense = _inputs(rows, features)
    specs = {name: e.spec for name, e in made.items() if isinstance(e, TreeRegressor)}
    grown = trees.fit(rows, scalar, label, specs) if specs else {}
    return {name: PipelineModel([TreeModel(grown[name])]) if name in grown else assembled(dense, e, scale).fit(rows)
            for name, e in made.items()}


def predict_all(df: DataFrame, models: Mapping[str, PipelineModel], keep: Sequence[str], label: str = C.TARGET) -> DataFrame:
    """Every model's predictions stacked: ``keep``, ``model``, ``y_true``, ``y_pred``. One pass over the rows."""
    if not models:
        raise ValueError("no models")
    out, wanted, done = df, list(df.columns), []
    grown = {f"_y{i}": m.stages[-1].ensemble for i, m in enumerate(models.values()) if isinstance(m.stages[-1], TreeModel)}
    for i, model in enumerate(models.values()):
        if f"_y{i}" not in grown:
            done.append(f"_y{i}")
            out = model.transform(out).withColumnRenamed("y_pred", f"_y{i}").select(*wanted, *done)
    if grown:
        out = trees.predict(out, grown)
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_y{i}").alias("y_pred")) for i, n in enumerate(models)])
    return out.select(*keep, F.col(label).alias("y_true"), F.inline(pairs)).select(*keep, "model", "y_true", "y_pred")


def train_and_evaluate(
    df: DataFrame, features: Sequence[str], factories: Mapping[str, Factory], label: str = C.TARGET
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Fit on the train split; stacked predictions and one metric table over validation and test.

    The split table is written once, by split; fits and predictions read their part of it. Predictions are written once too.
    """
    keep = [C.PLANT, C.TS, "split", C.RADIATION]
    rows = cut_lineage(df.select(*dict.fromkeys([*keep, *features, label])), ("split",))
    models = fit_all(rows.filter(F.col("split") == "train"), features, factories, label, written=True)
    stacked = cut_lineage(predict_all(rows.filter(F.col("split") != "train"), models, keep, label))
    return models, stacked, evaluate.metrics(stacked, ("split", "model"))


def external_predictions(df: DataFrame, predict: Callable[[pd.DataFrame], Sequence[float]], features: Sequence[str],
                         keep: Sequence[str], name: str, label: str = C.TARGET) -> DataFrame:
    """Predictions of a model from outside Spark, batch by batch on the executors."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("model", T.StringType()), T.StructField("y_true", T.DoubleType()),
                           T.StructField("y_pred", T.DoubleType())])
    wanted, kept = list(features), list(keep)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[kept].copy()
            out["model"] = name
            out["y_true"] = frame[label]
            out["y_pred"] = pd.Series(predict(frame[wanted]), index=frame.index, dtype="float64")
            yield out

    return df.select(*dict.fromkeys([*kept, label, *wanted])).mapInPandas(batches, schema)


def feature_importance(spark, models: Mapping[object, Model], features: Sequence[str], key: str = "horizon_steps") -> DataFrame:
    """Importances per model as rows, normalised to shares (features x models rows)."""
    rows = []
    for label, fitted in models.items():
        last = fitted.stages[-1] if isinstance(fitted, PipelineModel) else fitted
        values = last.featureImportances.toArray()
        total = float(values.sum()) or 1.0
        rows += [(label, f, float(v) / total) for f, v in zip(features, values)]
    kind = "int" if all(isinstance(r[0], int) for r in rows) else "string"
    return spark.createDataFrame(rows, f"{key} {kind}, feature string, importance double")
