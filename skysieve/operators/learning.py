"""Training and scoring with Spark ML: boosted trees, network, mixtures, calibration, importance."""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from skysieve import contracts as C
from skysieve.functions.numeric import argmax_label
from skysieve.operators import decision as D
from skysieve.operators import evaluation as E
from skysieve.operators.boosting import Forest, fit_forest, forest_probabilities
from skysieve.operators.guards import require_columns
from skysieve.operators.sampling import KEY_RANGE, random_position, stratified_folds, stratified_split
from skysieve.session import materialise

KINDS = ("boosted_trees", "network", "mixture")
#: Fits of a validation that run side by side.
FOLDS_AT_ONCE = 8
#: Rows of a fit in steps: tasks per core, and rows that one task may hold.
TASKS_PER_CORE = 4
ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class ModelSpec:
    """Model kind and its size; the defaults are the benchmark settings.

    All kinds are fitted on all rows; `sample_rows` is known from older saved specs and bounds nothing.
    """

    kind: str = "boosted_trees"
    iterations: int | None = None
    learning_rate: float = 0.1
    leaves: int = 31
    depth: int | None = None
    min_leaf_rows: int = 20
    sample_rows: int | None = None
    hidden: tuple[int, ...] = (32, 16)
    components: int = 2
    seed: int = 42

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown model kind {self.kind!r}; choose from {', '.join(KINDS)}")

    def steps(self) -> int:
        return self.iterations or {"boosted_trees": 200, "network": 300, "mixture": 200}[self.kind]


@dataclass
class StarModel:
    """A fitted classifier: shared preparation, and a forest, a network or mixtures."""

    task: C.Task
    spec: ModelSpec
    labels: list[str]
    prepare: PipelineModel
    parts: list = field(default_factory=list)
    mixtures: list = field(default_factory=list)
    forest: Forest | None = None
    n_rows: int = 0

    @property
    def probability_columns(self) -> dict[str, str]:
        return {x: f"probability__{x}" for x in self.labels}


# --- preparation ----------------------------------------------------------------------


def preprocessor(features, *, scale: bool) -> Pipeline:
    """Median imputation and, when asked, standard scaling."""
    filled = [f"_filled_{f}" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled, relativeError=0.001),
        VectorAssembler(inputCols=filled, outputCol="_raw" if scale else "_features"),
    ]
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_features"))
    return Pipeline(stages=stages)


def _prepared(model: PipelineModel, df: DataFrame, features) -> DataFrame:
    doubles = df.withColumns({f: F.col(f).cast("double") for f in features})
    out = model.transform(doubles)
    return out.drop("_raw", *[f"_filled_{f}" for f in features])


# --- fitting --------------------------------------------------------------------------


def fit(df: DataFrame, task: C.Task, spec: ModelSpec = ModelSpec()) -> StarModel:
    """Train one classifier on a task frame."""
    require_columns(df, (task.target, *task.features), f"frame of task {task.name}")
    target = F.col(task.target).cast("string")
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in task.features], target.alias("_target"))
    rows = rows.where(F.col("_target").isNotNull())
    counts = {r["_target"]: r["n"] for r in rows.groupBy("_target").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if len(labels) < 2:
        raise ValueError(f"task {task.name} needs two labels or more, got {labels}")
    prepare = preprocessor(task.features, scale=spec.kind != "boosted_trees").fit(rows)
    ready = _prepared(prepare, rows, task.features).select("_features", "_target")
    model = StarModel(task, spec, labels, prepare, n_rows=sum(counts.values()))
    if spec.kind == "boosted_trees":
        model.forest = fit_forest(ready, labels, counts, spec)
        return model
    if spec.kind == "network":
        ready = dealt_evenly(ready, model.n_rows)
    ready = ready.persist()
    try:
        if spec.kind == "network":
            model.parts = [_fit_network(ready, labels, len(task.features), spec)]
        else:
            model.mixtures = _fit_mixtures(ready, labels, counts, spec)
    finally:
        ready.unpersist()
    return model


def dealt_evenly(df: DataFrame, n_rows: int) -> DataFrame:
    """Rows for a fit whose every step is one job: all cores get the same share, however the files are cut."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(TASKS_PER_CORE * cores, math.ceil(n_rows / ROWS_PER_TASK)))


def _fit_network(ready: DataFrame, labels, n_features: int, spec: ModelSpec):
    """Multi-layer perceptron over all labels."""
    index = F.array_position(F.lit(list(labels)), F.col("_target")) - 1
    net = MultilayerPerceptronClassifier(
        featuresCol="_features", labelCol="_y", layers=[n_features, *spec.hidden, len(labels)],
        maxIter=spec.steps(), seed=spec.seed,
    )
    return net.fit(ready.withColumn("_y", index.cast("double")))


def _fit_mixtures(ready: DataFrame, labels, counts, spec: ModelSpec):
    """One Gaussian mixture per label, kept as plain parameters."""
    out, total = [], sum(counts.values())
    for x in labels:
        k = max(1, min(spec.components, counts[x]))
        if k == 1:
            # Spark ML wants two components; one Gaussian is mean and covariance
            k = 2
        fitted = GaussianMixture(
            featuresCol="_features", k=k, maxIter=spec.steps(), seed=spec.seed
        ).fit(ready.where(F.col("_target") == x))
        parts = []
        for weight, g in zip(fitted.weights, fitted.gaussians, strict=True):
            cov = np.asarray(g.cov.toArray()) + 1e-6 * np.eye(len(g.mean))
            parts.append((float(weight), np.asarray(g.mean.toArray()), cov))
        out.append((math.log(counts[x] / total), parts))
    return out


def _mixture_probabilities(mixtures):
    """Vectorised class probabilities: softmax of log prior plus log likelihood."""

    @F.pandas_udf("array<double>")
    def probabilities(features: pd.Series) -> pd.Series:
        x = np.vstack(features.to_numpy())
        scores = []
        for prior, parts in mixtures:
            logs = []
            for weight, mean, cov in parts:
                low = np.linalg.cholesky(cov)
                z = np.linalg.solve(low, (x - mean).T)
                norm = mean.size * math.log(2 * math.pi) + 2 * np.log(np.diag(low)).sum()
                logs.append(math.log(max(weight, 1e-300)) - 0.5 * (norm + (z * z).sum(axis=0)))
            scores.append(prior + np.logaddexp.reduce(np.vstack(logs), axis=0))
        s = np.vstack(scores).T
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return pd.Series(list(s / s.sum(axis=1, keepdims=True)))

    return probabilities


# --- scoring --------------------------------------------------------------------------


def spread(df: DataFrame) -> DataFrame:
    """Few bytes, much work: tasks by the settings of the session, not by size."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def with_probabilities(df: DataFrame, model: StarModel) -> DataFrame:
    """Add one `probability__X` column per label, rows summing to one."""
    features = model.task.features
    require_columns(df, features, "scoring frame")
    # raw inputs are kept aside: preparation casts them to double
    ready = _prepared(model.prepare, df, features)
    cols = model.probability_columns
    if model.spec.kind == "network":
        out = model.parts[0].transform(ready)
        ready = out.withColumn("_p", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    elif model.spec.kind == "boosted_trees":
        ready = ready.withColumn("_p", forest_probabilities(model.forest, F.col("_features")))
    else:
        ready = ready.withColumn("_p", _mixture_probabilities(model.mixtures)(vector_to_array("_features")))
    ready = ready.withColumns({cols[x]: F.col("_p")[i] for i, x in enumerate(model.labels)}).drop("_p")
    return ready.drop("_features")


def score(df: DataFrame, model: StarModel, *, host_column: str = "host_similarity_score") -> DataFrame:
    """Predicted label, probabilities, confidence; the host score only for host models."""
    out = with_probabilities(df, model)
    p = [F.col(model.probability_columns[x]) for x in model.labels]
    name = f"predicted_{model.task.target}"
    out = out.withColumns({name: argmax_label(model.labels, p), f"{name}_confidence": F.array_max(F.array(*p))})
    if model.task.target == "host_label" and "host" in model.labels:
        out = out.withColumn(host_column, F.col(model.probability_columns["host"]))
    return out


def score_coarse(df: DataFrame, model: StarModel) -> DataFrame:
    """Coarse stage table: label, probability, margin per id."""
    scored = D.summarise_probabilities(
        with_probabilities(df, model), model.probability_columns, "coarse"
    )
    return scored.select(
        "source_id",
        "coarse_predicted_label",
        "coarse_probability_max",
        "coarse_probability_margin",
        F.lit(model.spec.kind).alias("coarse_model_name"),
    )


def score_family(df: DataFrame, model: StarModel, family: str) -> DataFrame:
    """Refinement stage table of one family; labels get the family letter."""
    from skysieve.functions.labels import family_label

    family = C.require_family(family)
    scored = D.summarise_probabilities(
        with_probabilities(df, model), model.probability_columns, "refinement"
    )
    return scored.select(
        "source_id",
        family_label(F.col("refinement_predicted_label"), family).alias("refinement_predicted_label"),
        "refinement_probability_max",
        "refinement_probability_margin",
        F.lit(family).alias("refinement_family_name"),
        F.lit(model.spec.kind).alias("refinement_model_name"),
    )


def score_boundary(df: DataFrame, model: StarModel, domain_name: str | None = None) -> DataFrame:
    """O/B boundary rows with all coarse probabilities beside the summary."""
    from skysieve.operators.boundary import scoring_frame

    out = D.summarise_probabilities(
        with_probabilities(scoring_frame(df), model), model.probability_columns, "coarse"
    ).withColumnsRenamed({c: f"coarse_{c}" for c in model.probability_columns.values()})
    out = out.withColumn("coarse_model_name", F.lit(model.spec.kind))
    return out if domain_name is None else out.withColumn("domain_name", F.lit(domain_name))


# --- benchmark ------------------------------------------------------------------------


def evaluate(df: DataFrame, model: StarModel, by=("split_name",)) -> DataFrame:
    """Metrics and AUC of scored rows per group; the rows are scored once and written, as both read them."""
    name = f"predicted_{model.task.target}"
    used = dict.fromkeys([*by, model.task.target, name, *model.probability_columns.values()])
    scored = materialise(score(spread(df), model).select(*used), "evaluated")
    metrics = E.classification_metrics(scored, model.task.target, name, by)
    return metrics.join(E.ovr_auc(scored, model.task.target, model.probability_columns, by), list(by), "left")


def _each_fold(protocol: C.Protocol, work) -> list:
    """`work(k)` of all folds, several at a time, as their jobs leave cores free; results in order."""
    target = inheritable_thread_target(SparkSession.active())(work)
    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        return list(pool.map(target, range(protocol.folds)))


def cross_validate(train: DataFrame, task: C.Task, spec: ModelSpec, protocol: C.Protocol) -> dict:
    """Mean fold scores; every fold is predicted by a model fitted on the other folds."""
    folds = materialise(stratified_folds(train, task.target, protocol), "folds")

    def measure(k):
        model = fit(folds.where(F.col("fold") != k), task, spec)
        held = score(spread(folds.where(F.col("fold") == k)), model)
        cells = materialise(E.confusion(held, task.target, f"predicted_{task.target}", ["fold"]), "fold-counts")
        return E.confusion_metrics(cells, ["fold"]).first()

    rows = _each_fold(protocol, measure)

    def mean(name):
        return float(np.mean([r[name] for r in rows]))

    return {
        "mean_accuracy": mean("accuracy"),
        "mean_balanced_accuracy": mean("balanced_accuracy"),
        "mean_macro_f1": mean("macro_f1"),
    }


@dataclass(frozen=True)
class Benchmark:
    metrics: DataFrame
    cv_summary: DataFrame
    target_distribution: DataFrame


def benchmark(
    df: DataFrame, task: C.Task, specs=(ModelSpec(),), protocol: C.Protocol = C.Protocol()
) -> Benchmark:
    """Split, fit, score and cross-validate several models on one frame."""
    spark = df.sparkSession
    split = materialise(stratified_split(df, task.strata, protocol), "split")
    train = split.where(F.col("split_name") == "train")
    metric_rows, cv_rows = [], []
    for spec in specs:
        started = time.perf_counter()
        model = fit(train, task, spec)
        fit_seconds = time.perf_counter() - started
        for r in evaluate(split, model).collect():
            metric_rows.append({"model_name": spec.kind, **r.asDict()})
        started = time.perf_counter()
        means = cross_validate(train, task, spec, protocol)
        cv_seconds = time.perf_counter() - started
        cv_rows.append(
            {
                "model_name": spec.kind,
                "cv_folds": protocol.folds,
                **means,
                "fit_seconds": fit_seconds,
                "cv_seconds": cv_seconds,
                "total_seconds": fit_seconds + cv_seconds,
            }
        )
    metric_schema = (
        "model_name string, split_name string, n_rows long, n_classes long, accuracy double, balanced_accuracy double, "
        "macro_precision double, macro_recall double, macro_f1 double, roc_auc_ovr double"
    )
    cv_schema = (
        "model_name string, cv_folds int, mean_accuracy double, mean_balanced_accuracy double, mean_macro_f1 double, "
        "fit_seconds double, cv_seconds double, total_seconds double"
    )
    return Benchmark(
        spark.createDataFrame(metric_rows, metric_schema),
        spark.createDataFrame(cv_rows, cv_schema),
        E.label_shares(split, task.target),
    )


# --- calibration and threshold --------------------------------------------------------


@dataclass
class CalibratedModel:
    """A binary model and the map from its score to a calibrated probability."""

    model: StarModel
    positive: str
    method: str
    calibrator: object
    threshold: float | None = None

    def apply(self, df: DataFrame, name: str) -> DataFrame:
        column = self.model.probability_columns[self.positive]
        scored = with_probabilities(df, self.model).withColumn("_s", F.col(column))
        return _calibrate(scored, self.calibrator, self.method, name).drop(
            "_s", *self.model.probability_columns.values()
        )


def _fit_calibrator(rows: DataFrame, method: str):
    """`rows` holds out-of-fold scores `_s` and 0/1 targets `y`."""
    if method == "sigmoid":
        n = rows.agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
        # targets are drawn in by one pseudo row of either side; a row counts for both sides by its target
        share = F.when(F.col("y") == 1, (n["pos"] + 1.0) / (n["pos"] + 2.0)).otherwise(1.0 / (n["neg"] + 2.0))
        sides = F.array(F.struct(F.lit(1.0).alias("y"), share.alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - share).alias("w")))
        smooth = rows.select("_s", F.inline(sides))
        ready = VectorAssembler(inputCols=["_s"], outputCol="_v").transform(smooth)
        return LogisticRegression(featuresCol="_v", labelCol="y", weightCol="w", maxIter=100).fit(ready)
    if method == "isotonic":
        return IsotonicRegression(featuresCol="_s", labelCol="y").fit(rows.withColumn("y", F.col("y").cast("double")))
    raise ValueError("calibration method must be sigmoid or isotonic")


def _calibrate(df: DataFrame, calibrator, method: str, name: str) -> DataFrame:
    if method == "sigmoid":
        a, b = float(calibrator.coefficients[0]), float(calibrator.intercept)
        return df.withColumn(name, 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("_s") + F.lit(b)))))
    return calibrator.transform(df).withColumnRenamed("prediction", name)


def out_of_fold(df: DataFrame, task: C.Task, spec: ModelSpec, positive: str, protocol: C.Protocol) -> DataFrame:
    """Score every row with a model that has not seen its fold."""
    folds = materialise(stratified_folds(df, task.target, protocol), "folds")

    def held_out(k):
        model = fit(folds.where(F.col("fold") != k), task, spec)
        return with_probabilities(folds.where(F.col("fold") == k), model).select(
            "source_id",
            F.coalesce((F.col(task.target) == positive).cast("int"), F.lit(0)).alias("y"),
            F.col(model.probability_columns[positive]).alias("_s"),
        )

    return reduce(DataFrame.unionByName, _each_fold(protocol, held_out))


def calibrated(
    df: DataFrame, task: C.Task, positive: str, spec: ModelSpec = ModelSpec(), *,
    method: str = "sigmoid", folds: int = 5, thresholds: int | None = 100,
) -> CalibratedModel:
    """Calibrate on out-of-fold scores (M12) and tune the cut on them."""
    held = materialise(out_of_fold(df, task, spec, positive, C.Protocol(folds=folds)), "out-of-fold")
    calibrator = _fit_calibrator(held, method)
    model = CalibratedModel(fit(df, task, spec), positive, method, calibrator)
    if thresholds:
        rows = _calibrate(held, calibrator, method, "p").select("y", "p")
        model.threshold = float(E.best_threshold(E.threshold_table(rows, thresholds)).first()["threshold"])
    return model


@dataclass(frozen=True)
class GateRun:
    policy: C.OodPolicy
    model: CalibratedModel
    scored: DataFrame
    metrics: DataFrame


def fit_ood_gate(
    df: DataFrame, spec: ModelSpec = ModelSpec(), *, protocol: C.Protocol = C.Protocol(), folds: int = 5,
    method: str = "sigmoid", candidate_threshold: float | None = None, version: str = "id_ood_threshold_v1",
) -> GateRun:
    """Split, calibrate, tune, score both parts with the tuned cut, measure."""
    task = C.OOD_TASK
    split = materialise(stratified_split(df, task.strata, protocol), "split")
    model = calibrated(split.where("split_name = 'train'"), task, "ood", spec, method=method, folds=folds)
    if candidate_threshold is not None and not 0 <= candidate_threshold <= model.threshold:
        raise ValueError(f"candidate threshold {candidate_threshold} is not between 0 and the tuned {model.threshold}")
    policy = C.OodPolicy(model.threshold, candidate_threshold, version, fit_scope=f"cv_{folds}")
    scored = D.score_domain(model.apply(split, "ood_probability"), policy)
    metrics = E.classification_metrics(scored, "domain_target", "predicted_domain_target").join(
        E.ovr_auc(scored, "domain_target", {"id": "id_probability", "ood": "ood_probability"}), "split_name"
    )
    return GateRun(policy, model, scored, metrics)


# --- importance -----------------------------------------------------------------------


def permutation_importance(
    df: DataFrame, model: StarModel, *, repeats: int = 20, seed: int = 42, target: str | None = None,
    positive: str | None = "O",
) -> DataFrame:
    """Loss of accuracy when one feature is shuffled, mean and spread over repeats.

    Scores count whether a row is `positive` against whether it was called so (all classes apart if it is None).
    Each repeat puts the rows into a random order and takes the shuffled value from the next row; all repeats are
    numbered in one pass, and all features are scored in one pass over the paired rows. The rows as they are have the
    same score in every repeat, so they are scored once.
    """
    target, features = target or model.task.target, list(model.task.features)
    base = df.select("source_id", F.col(target).cast("string").alias("_t"), *features)
    turns = base.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.pmod(F.xxhash64(F.col("source_id").cast("string"), "_repeat", F.lit(seed)), F.lit(KEY_RANGE))
    placed = materialise(random_position(turns, ["_repeat"], order, "_pos"), "importance-order")
    rows_each = placed.groupBy("_repeat").agg(F.max("_pos").alias("_n"))
    donor = placed.join(F.broadcast(rows_each), "_repeat").select(  # one row per repeat
        "_repeat",
        (F.pmod(F.col("_pos"), F.col("_n")) + 1).alias("_pos"),
        *[F.col(f).alias(f"_d_{f}") for f in features],
    )
    parts = spread(placed.join(donor, ["_repeat", "_pos"]))
    versions = F.array(
        *[
            F.struct(
                F.lit(swap).alias("feature_name"),
                *[F.col(f"_d_{f}" if f == swap else f).cast("double").alias(f) for f in features],
            )
            for swap in features
        ]
    )
    rows = parts.select("_t", "_repeat", F.explode(versions).alias("v")).select("_t", "_repeat", "v.*")
    called = f"predicted_{model.task.target}"

    def measured(rows, by):
        scored = score(rows, model)
        if positive is not None:
            side = lambda c: F.when(F.col(c) == positive, positive).otherwise(f"not {positive}")
            scored = scored.withColumns({"_t": side("_t"), called: side(called)})
        # two aggregates read the counts; written, they stand for one scoring of the rows
        cells = materialise(E.confusion(scored, "_t", called, by), "importance-counts")
        return E.confusion_metrics(cells, by).select(*by, "accuracy", "balanced_accuracy")

    m = measured(rows, ["_repeat", "feature_name"])
    whole = measured(spread(base).withColumn("_all", F.lit(0)), ["_all"]).select(
        F.col("accuracy").alias("_a"), F.col("balanced_accuracy").alias("_b")
    )
    drops = m.crossJoin(whole).select(  # one row
        "feature_name",
        (F.col("_a") - F.col("accuracy")).alias("accuracy"),
        (F.col("_b") - F.col("balanced_accuracy")).alias("balanced_accuracy"),
    )
    return (
        drops.unpivot(["feature_name"], ["accuracy", "balanced_accuracy"], "metric_name", "drop")
        .groupBy("metric_name", "feature_name")
        .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
    )
