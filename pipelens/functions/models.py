"""Models: fitting is a sink of the DAG, scoring an operator with three inputs.

Features and labels are frames over the same rows; they are joined by row. A label frame holds one column, or a 0/1
array from ``label_binarize``. The learners are Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions.transformers import MODULE, as_array
from pipelens.operators.frame import ORD, InspectedFrame, q, tracked
from pipelens.plans.model import OperatorType
from pipelens.plans.recorder import suspended


def _label(frame: InspectedFrame):
    c = frame.columns[0]
    return F.element_at(q(c), 1) if dict(frame.hidden.dtypes)[c].startswith("array") else q(c).cast("double")


def _rows(data: InspectedFrame, labels: InspectedFrame) -> DataFrame:
    """(features, label, __ord, annotations of both sides), a row for each row of the two frames."""
    names = [a.name for a in data.recorder.annotations]
    x = data.hidden.select(q(ORD), array_to_vector("array").alias("features"), *[q(n) for n in names])
    y = labels.hidden.select(q(ORD).alias("__o"), _label(labels).alias("label"), *[q(n).alias(f"{n}__y") for n in names])
    return x.join(y, F.col(ORD) == F.col("__o")).drop("__o")


def accuracy(labels_and_predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of equal values."""
    return labels_and_predictions.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


class Model:
    described = ""

    def __init__(self, **args: Any):
        self.args = args

    def learner(self, rows: DataFrame):
        raise NotImplementedError

    def _marked(self, frame: InspectedFrame, operator: OperatorType, columns: Sequence[str]) -> InspectedFrame:
        return frame._unary(operator, (MODULE, type(self).__name__), None, lambda df: df, columns)

    def _fit(self, rows: DataFrame, recorder) -> Any:
        with suspended(recorder):
            return self.learner(rows).fit(rows)

    def fit(self, data: InspectedFrame, labels: InspectedFrame) -> Model:
        data, labels = tracked(data), tracked(labels)
        recorder = data.recorder
        data = self._marked(as_array(data), OperatorType.TRAIN_DATA, ["array"])
        labels = self._marked(labels, OperatorType.TRAIN_LABELS, ["array"])
        rows = _rows(data, labels)
        self.model = self._fit(rows.select("features", "label"), recorder)
        names = [a.name for a in recorder.annotations]
        hidden = {a.name: a.nary({}, [q(a.name), q(f"{a.name}__y")]) for a in recorder.annotations} if names else {}
        node = recorder.add(OperatorType.ESTIMATOR, (MODULE, type(self).__name__), self.described, [], [data.node, labels.node], self.args)
        self.node = node
        InspectedFrame(rows.select(q(ORD), *[v.alias(k) for k, v in hidden.items()]), node, recorder)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows)

    def score(self, data: InspectedFrame, labels: InspectedFrame) -> float:
        """Accuracy on a test set."""
        return self.scored(data, labels).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    def scored(self, data: InspectedFrame, labels: InspectedFrame) -> DataFrame:
        data, labels = tracked(data), tracked(labels)
        recorder = data.recorder
        data_names, label_names = data.columns, labels.columns
        data = self._marked(as_array(data), OperatorType.TEST_DATA, data_names)
        labels = self._marked(labels, OperatorType.TEST_LABELS, label_names)
        rows = self.predict(_rows(data, labels))
        hidden = {a.name: a.nary({}, [q(a.name), q(f"{a.name}__y")]) for a in recorder.annotations}
        node = recorder.add(OperatorType.SCORE, (MODULE, type(self).__name__), self.described, [], [self.node, data.node, labels.node])
        out = rows.select(F.col("prediction").alias("array"), q(ORD), *[v.alias(k) for k, v in hidden.items()])
        InspectedFrame(out, node, recorder)
        return rows.select("label", "prediction")


class DecisionTreeClassifier(Model):
    described = "Decision Tree"

    def learner(self, rows):
        from pyspark.ml.classification import DecisionTreeClassifier as Learner

        return Learner(maxDepth=self.args.get("max_depth", 5), seed=self.args.get("random_state", 0), minInstancesPerNode=self.args.get("min_samples_leaf", 1))


class LogisticRegression(Model):
    described = "Logistic Regression"

    def learner(self, rows):
        from pyspark.ml.classification import LogisticRegression as Learner

        strength = 1.0 / (self.args.get("C", 1.0) * max(1, rows.count()))
        return Learner(regParam=strength, elasticNetParam=1.0 if self.args.get("penalty") == "l1" else 0.0, standardization=False, maxIter=self.args.get("max_iter", 100))


class SGDClassifier(Model):
    described = "SGD Classifier"

    def learner(self, rows):
        from pyspark.ml.classification import LinearSVC
        from pyspark.ml.classification import LogisticRegression as Logistic

        common = {"regParam": self.args.get("alpha", 1e-4), "standardization": False, "maxIter": self.args.get("max_iter", 100)}
        return Logistic(**common) if self.args.get("loss", "hinge") in ("log", "log_loss") else LinearSVC(**common)


class MLPClassifier(Model):
    described = "Neural Network"

    def learner(self, rows):
        from pyspark.ml.classification import MultilayerPerceptronClassifier

        width = len(rows.select("features").first()[0])
        classes = int(rows.agg(F.max("label")).first()[0]) + 1
        layers = [width, *self.args.get("hidden", [9, 9]), max(2, classes)]
        return MultilayerPerceptronClassifier(layers=layers, seed=self.args.get("random_state", 0), maxIter=self.args.get("epochs", 100))


class GridSearch(Model):
    """Cross-validated choice of a model's arguments; only the last fit is recorded."""

    def __init__(self, model: Model, grid: dict[str, Sequence[Any]], cv: int = 3, seed: int = 0):
        super().__init__(cv=cv, grid=grid)
        self.base, self.grid, self.cv, self.seed = model, grid, cv, seed

    def fit(self, data: InspectedFrame, labels: InspectedFrame) -> GridSearch:
        from itertools import product

        data, labels = tracked(data), tracked(labels)
        rows = _rows(as_array(data), labels).select("features", "label", q(ORD))
        choices = [dict(zip(self.grid, values)) for values in product(*self.grid.values())]
        fold = F.pmod(F.xxhash64(q(ORD), F.lit(self.seed)), F.lit(self.cv))
        rows = rows.withColumn("fold", fold).cache()
        try:
            best: tuple[float, int] | None = None
            with suspended(data.recorder):
                for i, choice in enumerate(choices):
                    trial, total = type(self.base)(**(self.base.args | choice)), 0.0
                    for k in range(self.cv):
                        train, test = rows.where(F.col("fold") != k).select("features", "label"), rows.where(F.col("fold") == k)
                        if train.select("label").distinct().count() < 2 or test.isEmpty():
                            continue
                        total += accuracy(trial.learner(train).fit(train).transform(test)).first()[0]
                    if best is None or total > best[0]:
                        best = (total, i)
        finally:
            rows.unpersist()
        self.best_args = self.base.args | choices[best[1]]
        self.best = type(self.base)(**self.best_args).fit(data, labels)
        self.node, self.model, self.described = self.best.node, self.best.model, self.best.described
        return self


class OLS(Model):
    """Least squares; features bring their own constant (``add_constant``), as there is no intercept besides."""

    described = "OLS"

    def _fit(self, rows, recorder):
        """The normal equations: sums of products from one aggregation, solved on the driver (width x width numbers)."""
        from pyspark.ml.functions import vector_to_array

        with suspended(recorder):
            width = len(rows.select("features").first()[0])
            x = [F.col("x")[i] for i in range(width)] + [F.col("label")]
            products = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
            data = rows.select(vector_to_array("features").alias("x"), "label")
            sums = data.agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in products]).first()
        gram = np.zeros((width + 1, width + 1))
        for i, j in products:
            gram[i, j] = gram[j, i] = sums[f"s{i}_{j}"]
        size = np.sqrt(np.maximum(np.diag(gram)[:width], 1e-300))
        scaled = gram[:width, :width] / size / size[:, None]
        return np.linalg.lstsq(scaled, gram[:width, width] / size, rcond=None)[0] / size

    def predict(self, rows):
        from pyspark.ml.functions import vector_to_array

        x = vector_to_array("features")
        return rows.withColumn("prediction", sum((x[i] * F.lit(float(w)) for i, w in enumerate(self.model)), F.lit(0.0)))

    @property
    def params(self) -> list[float]:
        return [float(x) for x in self.model]
