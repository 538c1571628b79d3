"""Learners of attachment and label weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLReadable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import mixing
from .pairs import attached_only, for_attachment

#: Learners by name; each takes rows with features (a vector) and label (0 to k - 1).
LEARNERS = {
    "logistic": lambda **k: LogisticRegression(standardization=False, **k), "svm": lambda **k: LinearSVC(**k),
    "forest": lambda **k: RandomForestClassifier(seed=0, **k), "bayes": lambda **k: NaiveBayes(**k),
}


class Scorer:
    """A fitted model that writes `attach` or `label_w`."""

    def __init__(self, model, task: str, n_labels: int = 2):
        self.model, self.task, self.n_labels = model, task, n_labels
        self.probabilistic = "probabilityCol" in {p.name for p in model.params}

    def transform(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(rows.drop("probability", "rawPrediction", "prediction"))
        out = vector_to_array("probability" if self.probabilistic else "rawPrediction")
        if self.task == "attach":
            scored = scored.withColumn("attach", out[1])
        else:
            # labels that the training rows lack weigh 0
            known = F.transform(F.sequence(F.lit(0), F.lit(self.n_labels - 1)), lambda i: F.coalesce(F.get(out, i.cast("int")), F.lit(0.0)))
            scored = scored.withColumn("label_w", known)
        return scored.drop("probability", "rawPrediction", "prediction")


def fit_attach(pairs: DataFrame, unrelated: int, learner: str = "logistic", nonfixed: Column | None = None, **options) -> Scorer:
    """A binary model of whether a pair is linked, from all pairs (or those that are not fixed)."""
    rows = pairs if nonfixed is None else pairs.where(nonfixed)
    rows = for_attachment(rows, unrelated).withColumn("label", (F.col("target") > 0).cast("double"))
    return Scorer(LEARNERS[learner](**options).fit(rows), "attach")


def fit_label(pairs: DataFrame, unrelated: int, n_labels: int, learner: str = "logistic", **options) -> Scorer:
    """A model of a link's label, from linked pairs only."""
    rows = attached_only(pairs, unrelated).withColumn("label", F.col("target").cast("double"))
    return Scorer(LEARNERS[learner](**options).fit(rows), "label", n_labels)


def regularisation(c: float, n: int) -> float:
    """The penalty that makes the mean loss of n rows weigh as their sum times c."""
    return 1.0 / (c * n)


def oracle_attach(pairs: DataFrame, unrelated: int, nonfixed: Column | None = None) -> DataFrame:
    """attach 1 for gold links, else 0; fixed pairs keep theirs."""
    new = (F.col("target") != unrelated).cast("double")
    if nonfixed is not None and "attach" in pairs.columns:
        new = F.when(nonfixed, new).otherwise(F.col("attach"))
    return pairs.withColumn("attach", new)


def oracle_label(pairs: DataFrame, n_labels: int, unrelated: int, unknown: int = 0) -> DataFrame:
    """label_w 1 for the gold label; a pair without a link has 1 on __UNK__."""
    gold = F.when(F.col("target") == unrelated, F.lit(unknown)).otherwise(F.col("target"))
    return pairs.withColumn("label_w", F.transform(F.sequence(F.lit(0), F.lit(n_labels - 1)), lambda i: (i == gold).cast("double")))


def _coefficients(scorer: Scorer) -> np.ndarray:
    model = scorer.model
    if hasattr(model, "coefficientMatrix"):
        return np.array(model.coefficientMatrix.toArray())
    if hasattr(model, "coefficients"):
        return np.array([model.coefficients.toArray()])
    if hasattr(model, "featureImportances"):
        return np.array([model.featureImportances.toArray()])
    return np.array(model.theta.toArray())


def top_features(spark, scorer: Scorer, vocab: Sequence[str], n: int = 10) -> DataFrame:
    """(row, rank, feature, value): the n largest coefficients of each row of a model's coefficients (one if binary)."""
    out = []
    for i, row in enumerate(_coefficients(scorer)):
        out += [(i, k, vocab[j], float(row[j])) for k, j in enumerate(np.argsort(-row, kind="stable")[:n].tolist())]
    return spark.createDataFrame(out, "row int, rank int, feature string, value double")


def top_features_per_label(spark, scorer: Scorer, vocab: Sequence[str], labels: Sequence[str], n: int = 10) -> DataFrame:
    named = spark.createDataFrame(list(enumerate(labels)), "row int, label string")
    return top_features(spark, scorer, vocab, n).join(F.broadcast(named), "row").drop("row")


def discriminating_features(spark, attach: Scorer, label: Scorer, vocab: Sequence[str], labels: Sequence[str], n: int = 10) -> DataFrame:
    """The attachment model's features as `(attach)`, each label's under its name, the label model's best as `(label)`."""
    one = top_features(spark, attach, vocab, n).where("row = 0").select("rank", "feature", "value").withColumn("label", F.lit("(attach)"))
    each = top_features_per_label(spark, label, vocab, labels, n).select("rank", "feature", "value", "label")
    top = each.groupBy("feature").agg(F.max("value").alias("value")).orderBy(F.desc("value"), "feature").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("value"), "feature")) - 1
    return one.unionByName(each).unionByName(top.select(rank.cast("int").alias("rank"), "feature", "value", F.lit("(label)").alias("label")))


def margin(long_rows: DataFrame, weights: DataFrame, by: Sequence[str] = ("grouping", "pair_ix")) -> DataFrame:
    """score (the sum of value * w) and sign of each row, from (by, feature_ix, value) and (feature_ix, w)."""
    scored = long_rows.join(weights, "feature_ix", "left").groupBy(*by).agg(F.sum(F.col("value") * F.coalesce("w", F.lit(0.0))).alias("score"))
    return scored.withColumn("sign", F.when(F.col("score") > 0, 1).otherwise(-1))


def sparse_items(features: Column) -> Column:
    """The items (ix, value) of an array of doubles, zeros left out."""
    each = F.transform(features, lambda v, i: F.struct(i.cast("long").alias("ix"), v.cast("double").alias("value")))
    return F.filter(each, lambda x: x["value"] != 0)


def weight_vector(weights: DataFrame, n_features: int) -> np.ndarray:
    """The weights of a small feature space as an array; for wide ones use the table with `margin`."""
    out = np.zeros(n_features)
    for r in weights.where(F.col("feature_ix") < n_features).collect():
        out[r["feature_ix"]] = r["w"]
    return out


def train_linear(
    rows: DataFrame, n_features: int, kind: str = "perceptron", epochs: int = 5, c: float = 1.0, eta: float = 1.0, average: bool = True
) -> np.ndarray:
    """`mixing.train_linear` for a few dense features: rows have features (an array of doubles) and y; partitions are the parts."""
    own = rows.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "y", sparse_items(F.col("features")).alias("items"))
    return weight_vector(mixing.train_linear(own, kind, epochs, c, eta, average), n_features)


def cached_model(path: str, kind: type[MLReadable], fit: Callable[[], object]):
    """The model saved at `path`, or a new one, which is saved there."""
    from pyspark.sql import SparkSession

    from .folds import _complete

    if _complete(SparkSession.active(), f"{path}/metadata"):
        return kind.load(path)
    model = fit()
    model.write().overwrite().save(path)
    return model
