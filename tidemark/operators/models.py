"""Boosted trees on feature tables: training, prediction, saving, importances, comparison. Spark's own learners do the work."""
from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from . import evaluation, factors


def settled(df: DataFrame) -> DataFrame:
    """df with its rows worked out once, in their partitions as they come: in the checkpoint folder where the session has
    one, else in the executors' storage. For what is trained on and compared several times."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


@contextmanager
def held(df: DataFrame):
    """df, whose rows are kept from their first use to the end of the block: learners go over them many times, and would
    work out the rows again from their sources each time."""
    df = df.persist()
    try:
        yield df
    finally:
        df.unpersist()


def _complete(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows without a null among features and label; features with categories as doubles, as only these stay nominal when
    they are assembled."""
    df = df.dropna(subset=[*features, label])
    for c in set(factors.categorical_info(df)) & set(features):
        df = df.withColumn(c, F.col(c).cast("double")).withMetadata(c, df.schema[c].metadata)
    return df


def train(df: DataFrame, features: list[str], label: str = "label", task: str = "classification", classes: int = 2, depth: int = 5, rate: float = 0.05, rounds: int = 50, subsample: float = 1.0, weight: str | None = None, validation: str | None = None, seed: int = 42) -> PipelineModel:
    """A pipeline that assembles the features and applies boosted trees: a binary classifier, one of several classes (one
    against the rest), or a regression. validation: a boolean column; its rows tell when to stop, which one against the rest
    can't do: with more than two classes it is an error. Rows with a null feature or label are left out. Labels of classes
    are 0, 1, ... Features with categories in their metadata are split by sets of these."""
    if validation and task != "regression" and classes > 2:
        raise ValueError("validation rows need a regression or two classes")
    df = _complete(df, features, label)
    bins = {"maxBins": max([32, *[n for c, n in factors.categorical_info(df).items() if c in features]])}
    settings = dict(featuresCol="_features", labelCol=label, maxDepth=depth, stepSize=rate, maxIter=rounds, subsamplingRate=subsample, seed=seed, **bins)
    if weight:
        settings["weightCol"] = weight
    if validation:
        settings["validationIndicatorCol"] = validation
    if task == "regression":
        learner = GBTRegressor(**settings)
    elif classes == 2:
        learner = GBTClassifier(**settings)
    else:
        learner = OneVsRest(classifier=GBTClassifier(**{k: v for k, v in settings.items() if k not in ("labelCol", "weightCol")}), featuresCol="_features", labelCol=label, weightCol=weight)
    with held(df) as rows:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), learner]).fit(rows)


def train_forest(df: DataFrame, features: list[str], label: str = "label", depth: int = 5, trees: int = 50, weight: str | None = None, seed: int = 42) -> PipelineModel:
    """A forest, which gives probabilities of any number of classes."""
    df = _complete(df, features, label)
    bins = max([32, *[n for c, n in factors.categorical_info(df).items() if c in features]])
    learner = RandomForestClassifier(featuresCol="_features", labelCol=label, maxDepth=depth, numTrees=trees, seed=seed, maxBins=bins, **({"weightCol": weight} if weight else {}))
    with held(df) as rows:
        return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), learner]).fit(rows)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with y_pred, and y_prob where the model has it: of class 1 for two classes, an array for more. Rows with a null
    feature are left out."""
    out = model.transform(df).withColumnRenamed("prediction", "y_pred")
    if "probability" in out.columns:
        p = vector_to_array("probability")
        two = out.select(F.size(p).alias("n")).first()
        out = out.withColumn("y_prob", p[1] if two is not None and two.n == 2 else p)
    return out.drop("_features", "rawPrediction", "probability")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: list[str], top: int = 20) -> list[tuple[str, float]]:
    """The features that count most, with their shares; as many numbers as features, so they are the driver's."""
    learner = model.stages[-1]
    parts = [m.featureImportances.toArray() for m in learner.models] if hasattr(learner, "models") else [learner.featureImportances.toArray()]
    mean = sum(parts) / len(parts)
    return sorted(zip(features, map(float, mean)), key=lambda x: (-x[1], x[0]))[:top]


def compare(models: dict[str, PipelineModel], df: DataFrame, label: str = "label") -> DataFrame:
    """(model, accuracy, means of precision, recall and F1) of classifiers on the same rows."""
    out = None
    for name, model in models.items():
        rows = predict(model, df).withColumn("y_true", F.col(label).cast("int")).withColumn("y_pred", F.col("y_pred").cast("int"))
        got = evaluation.accuracy_and_means(evaluation.class_report(rows)).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out
