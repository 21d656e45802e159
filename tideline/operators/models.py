"""Purged cross-validation, classifiers, selection by gates, persistence of bundles."""

from __future__ import annotations

import functools
import itertools
import random
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Purged folds -------------------------------------------------------------------------


def with_fold(events: DataFrame, n_splits: int = 5) -> DataFrame:
    """events (symbol, t0, ...) with pos (from 0) and fold: contiguous, the first n mod k folds one larger."""
    if n_splits < 2:
        raise ValueError("n_splits is 2 or more")
    w = Window.partitionBy("symbol")
    out = events.withColumn("pos", F.row_number().over(w.orderBy("t0")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    small, odd = F.floor(F.col("_n") / n_splits), F.col("_n") % n_splits
    early = odd * (small + 1)
    fold = F.when(F.col("pos") < early, F.floor(F.col("pos") / (small + 1))).otherwise(odd + F.floor(F.try_divide(F.col("pos") - early, small)))
    return out.withColumn("fold", fold.cast("int")).drop("_n")


def purged_splits(events: DataFrame, n_splits: int = 5, embargo: float = 0.01) -> DataFrame:
    """symbol, t0, fold, role: "test", or "train" for the rows that may train against the fold.

    A row trains if it ends (t1) before the fold's first start, or starts after its
    last start and stands more than the embargo (a share of all rows) behind it.
    Without a t1 column only the fold itself is left out.
    """
    w = Window.partitionBy("symbol")
    numbered = with_fold(events, n_splits).withColumn("_embargo", F.floor(F.count(F.lit(1)).over(w) * embargo))
    bounds = numbered.groupBy("symbol", "fold").agg(F.min("t0").alias("_start"), F.max("t0").alias("_end"), F.max("pos").alias("_last"))
    pairs = numbered.withColumnRenamed("fold", "_own").join(bounds, "symbol")
    if "t1" in events.columns:
        trains = (F.col("t1") < F.col("_start")) | ((F.col("t0") > F.col("_end")) & (F.col("pos") > F.col("_last") + F.col("_embargo")))
    else:
        trains = F.lit(True)
    role = F.when(F.col("_own") == F.col("fold"), "test").when(F.coalesce(trains, F.lit(False)), "train")
    return pairs.withColumn("role", role).filter("role is not null").select("symbol", "t0", "fold", "role")


def train_times(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events that don't overlap [start, end]: t1 before it or t0 after it."""
    return events.filter((F.col("t1") < start) | (F.col("t0") > end))


# Classifiers --------------------------------------------------------------------------


class Classifier:
    """A forest ("rf") or boosted trees ("gb") over feature columns and an integer label of any values.

    Missing features are imputed by their median.  predict() adds prediction (a label's
    value), probability (an array in the order of classes) and p_<class>.
    """

    def __init__(self, features: Sequence[str], *, label: str = "label", kind: str = "rf", trees: int = 100, depth: int = 5, least: int = 50, rate: float = 0.1, weight: str | None = None, seed: int = 42) -> None:
        if kind not in ("rf", "gb"):
            raise ValueError(f"unknown model type: {kind}")
        self.features, self.label, self.kind, self.weight, self.seed = list(features), label, kind, weight, seed
        self.trees, self.depth, self.least, self.rate = trees, depth, least, rate
        self.classes: list[int] = []
        self.model: PipelineModel | None = None

    def fit(self, rows: DataFrame) -> Classifier:
        rows = rows.filter(F.col(self.label).isNotNull()).withColumns({c: F.col(c).cast("double") for c in self.features})
        self.classes = [int(r[0]) for r in rows.select(F.col(self.label).cast("int")).distinct().orderBy(self.label).collect()]
        if not self.classes:
            raise ValueError("no rows to train on")
        index = {v: float(i) for i, v in enumerate(self.classes)}
        indexed = rows.withColumn("_y", F.create_map(*(F.lit(x) for item in index.items() for x in item))[F.col(self.label).cast("int")])
        filled = [f"_f{i}" for i in range(len(self.features))]
        prepared = [Imputer(inputCols=self.features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_x")]
        common = {"featuresCol": "_x", "labelCol": "_y", **({"weightCol": self.weight} if self.weight else {})}
        if self.kind == "rf":
            last = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=min(self.least, max(1, rows.count() // 4)), seed=self.seed, **common)
        else:
            trees = GBTClassifier(maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed, **common)
            last = trees if len(self.classes) <= 2 else OneVsRest(classifier=trees, **common)
        self.model = Pipeline(stages=[*prepared, last]).fit(indexed) if len(self.classes) > 1 else None
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:  # one class was seen
            return rows.withColumns({"prediction": F.lit(self.classes[0]), "probability": F.array(F.lit(1.0)), f"p_{self.classes[0]}": F.lit(1.0)})
        out = self.model.transform(rows.withColumns({c: F.col(c).cast("double") for c in self.features}))
        value = F.element_at(F.array(*map(F.lit, self.classes)), (F.col("_p") + 1).cast("int"))
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        else:  # one against the rest has no probability: the raw scores' softmax
            raw = vector_to_array("rawPrediction")
            out = out.withColumn("probability", F.transform(raw, lambda x: F.exp(x) / F.aggregate(raw, F.lit(0.0), lambda s, y: s + F.exp(y))))
        out = out.withColumn("_p", F.col("prediction")).withColumn("prediction", value)
        named = {f"p_{c}": F.try_element_at("probability", F.lit(i + 1)) for i, c in enumerate(self.classes)}
        return out.withColumns(named).select(*rows.columns, "prediction", "probability", *named)

    def importances(self) -> dict[str, float]:
        """Sorted, the largest first; empty for one class or one against the rest."""
        last = self.model.stages[-1] if self.model else None
        found = getattr(last, "featureImportances", None)
        return {} if found is None else dict(sorted(zip(self.features, found.toArray().tolist()), key=lambda x: -x[1]))


def scores(predicted: DataFrame, label: str = "label") -> dict[str, float]:
    """accuracy, and precision, recall and f1 weighted by class; one aggregation."""
    said, true = F.col("prediction").cast("int"), F.col(label).cast("int")
    cells = predicted.groupBy(said.alias("p"), true.alias("t")).count().collect()
    n = sum(r["count"] for r in cells)
    out = {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in {r["t"] for r in cells}:
        hit = sum(r["count"] for r in cells if r["t"] == c and r["p"] == c)
        of, taken = (sum(r["count"] for r in cells if r[k] == c) for k in ("t", "p"))
        p, q = hit / taken if taken else 0.0, hit / of
        for k, v in (("accuracy", hit / of), ("precision", p), ("recall", q), ("f1", 2 * p * q / (p + q) if p + q else 0.0)):
            out[k] += v * of / n
    return out


def cross_validate(rows: DataFrame, make: Callable[[], Classifier], *, n_splits: int = 5, embargo: float = 0.01, metric: str = "accuracy", label: str = "label") -> dict:
    """scores of each purged fold, their mean, population std, and the folds' sizes; rows have symbol, t0 and possibly t1."""
    keys = ["symbol", "t0"]
    splits = purged_splits(rows.select(*keys, *(["t1"] if "t1" in rows.columns else [])), n_splits, embargo)
    # the split table once, a row for each row's role in each fold; its blocks can be made again from the plan
    split = rows.join(splits, keys).persist()
    counts = {(r["fold"], r["role"]): r["count"] for r in split.groupBy("fold", "role").count().collect()}
    found, sizes = [], []
    for fold in range(n_splits):
        n_train, n_test = (counts.get((fold, role), 0) for role in ("train", "test"))
        if not n_train or not n_test:
            continue
        part = lambda role: split.filter((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")  # noqa: E731, B023
        found.append(scores(make().fit(part("train")).predict(part("test")), label)[metric])
        sizes.append((n_train, n_test))
    split.unpersist()
    mean = sum(found) / len(found) if found else 0.0
    return {"scores": found, "mean": mean, "std": (sum((x - mean) ** 2 for x in found) / len(found)) ** 0.5 if found else 0.0, "sizes": sizes}


def train_primary(rows: DataFrame, features: Sequence[str], *, kind: str = "rf", cv: int = 5, weight: str | None = None, seed: int = 42, **how) -> tuple[Classifier, dict]:
    """Cross-validated, then fitted on all: the model, and metrics with importances."""
    defaults = {"trees": 100, "depth": 5, "least": 50} if kind == "rf" else {"trees": 100, "depth": 3, "rate": 0.1}
    make = lambda: Classifier(features, kind=kind, weight=weight, seed=seed, **{**defaults, **how})
    found = cross_validate(rows, make, n_splits=cv) if cv >= 2 else {"scores": [], "mean": 0.0, "std": 0.0, "sizes": []}
    model = make().fit(rows)
    return model, {"cv_mean": found["mean"], "cv_std": found["std"], "cv_scores": found["scores"], "n_samples": rows.count(), "importances": model.importances()}


def train_meta(rows: DataFrame, features: Sequence[str], *, held: float = 0.2, seed: int = 42, **how) -> tuple[Classifier, dict]:
    """A small forest on all but the share ``held`` of the rows, by hash of the key; metrics on that share."""
    test = F.pmod(F.xxhash64(F.lit(seed), "symbol", "t0"), F.lit(10_000)) < round(held * 10_000)
    train, other = rows.filter(~test), rows.filter(test)
    model = Classifier(features, kind="rf", seed=seed, **{"trees": 50, "depth": 3, "least": 100, **how}).fit(train)
    n, m = train.count(), other.count()
    return model, {"train_size": n, "test_size": m, **(scores(model.predict(other)) if m else {})}


def train_by(rows: DataFrame, group: str, features: Sequence[str], *, least: int = 100, cv: int = 3, **how) -> dict[str, tuple[Classifier, dict]]:
    """A primary model for each value of a column (strategy or regime) that has enough rows."""
    sizes = {r[group]: r["count"] for r in rows.groupBy(group).count().collect()}
    return {k: train_primary(rows.filter(F.col(group) == k), features, cv=cv, **how) for k, n in sorted(sizes.items()) if n >= least}


def by_symbol(rows: DataFrame, own: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """own() of each symbol's rows, one after the other, in one frame; a column that a symbol's lacks is NULL."""
    symbols = sorted(r.symbol for r in rows.select("symbol").distinct().collect())
    if not symbols:
        raise ValueError("no rows to train on")
    parts = [own(rows.filter(F.col("symbol") == s)) for s in symbols]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def refit(model: Classifier, rows: DataFrame) -> Classifier:
    """The same settings on new rows."""
    return Classifier(model.features, label=model.label, kind=model.kind, trees=model.trees, depth=model.depth, least=model.least, rate=model.rate, weight=model.weight, seed=model.seed).fit(rows)


GRID = {"trees": (50, 100, 200), "depth": (3, 5, 7, 10), "least": (20, 50, 100)}


def candidates(grid: Mapping[str, Sequence], method: str = "random", n: int = 20, seed: int = 42) -> Iterator[dict]:
    every = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if method == "grid":
        yield from every
    elif method == "random":
        yield from random.Random(seed).sample(every, min(n, len(every)))
    else:
        raise ValueError(f"unknown method: {method}")


def search(rows: DataFrame, features: Sequence[str], *, grid: Mapping[str, Sequence] = GRID, method: str = "random", n: int = 20, cv: int = 5, seed: int = 42) -> tuple[Classifier, dict]:
    """The settings with the best purged cross-validation, fitted on all rows; settings and score."""
    tried = [(cross_validate(rows, lambda p=p: Classifier(features, seed=seed, **p), n_splits=cv)["mean"], p) for p in candidates(grid, method, n, seed)]  # noqa: B008
    best, params = max(tried, key=lambda x: x[0])
    return Classifier(features, seed=seed, **params).fit(rows), {"params": params, "score": best}


# Gates --------------------------------------------------------------------------------


def gated(rows: DataFrame, primary: Classifier, meta: Classifier, preferred: DataFrame | None = None, *, threshold: float | None = None) -> DataFrame:
    """rows with primary (the side), meta (1 to take it), regime_ok, final (the side where all gates pass, else 0) and confidence.

    ``preferred`` (regime, strategy) closes the regime gate for rows (with both
    columns) that it knows and doesn't name.  ``threshold`` on the meta model's
    probability of 1 replaces its vote.
    """
    from .ensemble import compatible

    first = primary.predict(rows).withColumnsRenamed({"prediction": "primary", "probability": "_pp"}).drop(*(f"p_{c}" for c in primary.classes))
    second = meta.predict(first.withColumn("primary_pred", F.col("primary")))
    take = F.coalesce(F.col("p_1") if 1 in meta.classes else F.lit(0.0), F.lit(0.0))
    vote = (take >= threshold) if threshold is not None else (F.col("prediction") != 0)
    out = second.withColumn("meta", vote.cast("int")).withColumn("confidence", F.coalesce(F.array_max("_pp"), F.lit(0.5)))
    out = compatible(out, preferred).withColumnRenamed("compatible", "regime_ok") if preferred is not None else out.withColumn("regime_ok", F.lit(True))
    final = F.when((F.col("primary") != 0) & (F.col("meta") == 1) & F.col("regime_ok"), F.col("primary")).otherwise(0)
    return out.withColumn("final", final).select(*rows.columns, "primary", "meta", "regime_ok", "final", "confidence")
