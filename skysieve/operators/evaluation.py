"""Evaluation of predictions as aggregations: metrics, AUC, calibration, separability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skysieve.operators.distributions import as_label, with_share
from skysieve.operators.ordered import (
    exact_quantiles,
    grouped_auc,
    grouped_summary,
    null_safe_join,
    with_edge_count,
)

LOG_LOSS_EPS = 2.220446049250313e-16


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def confusion(df: DataFrame, target: str, prediction: str, by=()) -> DataFrame:
    return df.groupBy(
        *by,
        F.col(target).cast("string").alias("true_label"),
        F.col(prediction).cast("string").alias("predicted_label"),
    ).agg(F.count("*").alias("n_rows"))


def classification_metrics(df: DataFrame, target: str, prediction: str, by=("split_name",)) -> DataFrame:
    """Accuracy, balanced accuracy and macro scores per group.

    Only the confusion counts, classes squared in size, are reduced further.
    Recall averages over true classes, macro scores over true and predicted ones.
    """
    by = list(by)
    return confusion_metrics(confusion(df, target, prediction, by), by)


def confusion_metrics(cells: DataFrame, by) -> DataFrame:
    """The metrics of confusion counts; they are read twice."""
    by = list(by)
    hit = F.when(F.col("true_label") == F.col("predicted_label"), F.col("n_rows")).otherwise(0)
    truth = cells.groupBy(*by, F.col("true_label").alias("label")).agg(
        F.sum("n_rows").alias("support"), F.sum(hit).alias("tp")
    )
    called = cells.groupBy(*by, F.col("predicted_label").alias("label")).agg(F.sum("n_rows").alias("called"))
    labels = truth.join(called, [*by, "label"], "full")
    tp = F.coalesce("tp", F.lit(0))
    support, predicted = F.coalesce("support", F.lit(0)), F.coalesce("called", F.lit(0))
    scored = labels.select(
        *by,
        support.alias("support"),
        tp.alias("tp"),
        ratio(tp, predicted).alias("p"),
        ratio(tp, support).alias("r"),
        ratio(2.0 * tp, support + predicted).alias("f"),
    )
    seen = F.col("support") > 0
    return scored.groupBy(*by).agg(
        F.sum("support").alias("n_rows"),
        F.count_if(seen).alias("n_classes"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(seen, F.col("r"))).alias("balanced_accuracy"),
        F.avg("p").alias("macro_precision"),
        F.avg("r").alias("macro_recall"),
        F.avg("f").alias("macro_f1"),
    )


def ovr_auc(df: DataFrame, target: str, probabilities: dict[str, str], by=("split_name",)) -> DataFrame:
    """ROC AUC per group: of the second label when there are two, else macro one-vs-rest.

    NULL when a label never occurs as the truth, or a group holds other labels.
    """
    by, labels = list(by), sorted(probabilities)
    ask = labels[1:] if len(labels) == 2 else labels
    rows = df.select(
        *by,
        F.col(target).cast("string").alias("_t"),
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(x).alias("label"), F.col(probabilities[x]).cast("double").alias("p"))
                    for x in ask
                ]
            )
        ).alias("s"),
    ).select(*by, "s.label", "s.p", F.col("_t").eqNullSafe(F.col("s.label")).alias("hit"), "_t")
    aucs = grouped_auc(rows, [*by, "label"], "p", "hit")
    out = aucs.groupBy(*by).agg(
        F.when(F.count("auc") == len(ask), F.avg("auc")).alias("roc_auc_ovr")
    )
    if len(labels) == 2:
        return out
    strange = df.groupBy(*by).agg(
        F.count_if(~F.coalesce(F.col(target).isin(*labels), F.lit(False))).alias("_x")
    )
    return null_safe_join(out, strange, by).select(
        *by, F.when(F.col("_x") == 0, F.col("roc_auc_ovr")).alias("roc_auc_ovr")
    )


# --- binary calibration ---------------------------------------------------------------


def binary_rows(df: DataFrame, target: str, score: str, positive: str) -> DataFrame:
    """`y` 0/1 and probability `p`; rows without a probability drop out."""
    return df.select(
        F.coalesce((F.col(target).cast("string") == positive).cast("int"), F.lit(0)).alias("y"),
        F.col(score).try_cast("double").alias("p"),
    ).where(F.col("p").isNotNull() & ~F.isnan("p"))


def calibration_summary(rows: DataFrame) -> DataFrame:
    """Row count, base rate, mean probability, Brier score, log loss, AUC."""
    p = F.greatest(F.lit(LOG_LOSS_EPS), F.least(F.lit(1.0 - LOG_LOSS_EPS), F.col("p")))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1.0 - p))
    base = rows.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.avg("y"), F.lit(0.0)).alias("positive_rate"),
        F.coalesce(F.avg("p"), F.lit(0.0)).alias("mean_predicted_probability"),
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier_score"),
        F.avg(loss).alias("log_loss"),
    )
    auc = grouped_auc(rows.withColumn("hit", F.col("y") == 1), [], "p", "hit")
    return base.withColumn("roc_auc", auc.select("auc").scalar())


def calibration_curve(rows: DataFrame, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """Observed rate against mean probability per bin, empty bins left out."""
    if bins < 2 or strategy not in ("quantile", "uniform"):
        raise ValueError("need two bins or more and strategy quantile or uniform")
    marks = [i / bins for i in range(1, bins)]
    if strategy == "uniform":
        edges = marks
    else:
        found = exact_quantiles(rows, [], ["p"], marks).first()
        edges = [found[f"q{i}"] for i in range(len(marks))] if found else marks
    binned = with_edge_count(rows, "_bin", F.col("p"), F.lit(edges), len(edges))
    curve = binned.groupBy("_bin").agg(
        F.avg("p").alias("mean_predicted_probability"), F.avg("y").alias("fraction_of_positives")
    )
    # at most `bins` rows are left to be numbered
    return curve.withColumn("bin_index", F.row_number().over(W.orderBy("_bin"))).drop("_bin")


def probability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Fixed bins open on the left; a probability of 0 lies in none and keeps a NULL bin."""
    edges = [i * (1.0 / bins) for i in range(bins)] + [1.0]
    names = [f"({round(a, 10)}, {round(b, 10)}]" for a, b in zip(edges, edges[1:])]
    at = F.col("_bin")
    label = F.when((at > 0) & (at <= bins), F.get(F.lit(names), at - 1))
    binned = with_edge_count(rows, "_bin", F.col("p"), F.lit(edges), len(edges))
    counts = binned.groupBy(label.alias("probability_bin")).agg(
        F.count("*").alias("n_rows"),
        F.avg("y").alias("positive_rate"),
        F.avg("p").alias("mean_probability"),
    )
    return with_share(counts)


def calibration_by_group(df: DataFrame, group: str, target: str, score: str, positive: str) -> DataFrame:
    """Base rate and score level per class or stage."""
    rows = df.select(
        F.col(group).cast("string").alias(group),
        F.coalesce((F.col(target) == positive).cast("int"), F.lit(0)).alias("y"),
        F.col(score).try_cast("double").alias("p"),
    ).where(F.col("p").isNotNull() & ~F.isnan("p"))
    return grouped_summary(
        rows,
        [group],
        [
            F.count("*").alias("n_rows"),
            F.avg("y").alias("positive_rate"),
            F.avg("p").alias("mean_host_similarity_score"),
        ],
        {"median_host_similarity_score": "p"},
    )


def split_summary(df: DataFrame, target: str, positive: str) -> DataFrame:
    """Sizes and base rates of both parts."""
    test, hit = F.col("split_name") == "test", (F.col(target) == positive).cast("int")
    return df.agg(
        F.count("*").alias("n_rows_full"),
        F.count_if(~test).alias("n_rows_train"),
        F.count_if(test).alias("n_rows_test"),
        F.avg(F.when(~test, hit)).alias("train_positive_rate"),
        F.avg(F.when(test, hit)).alias("test_positive_rate"),
    )


# --- separability ---------------------------------------------------------------------


def separability(df: DataFrame, groups, features, side: str, high: str, low: str) -> DataFrame:
    """Per group and feature: AUC of side `high` against `low`, and both medians.

    All features go through one job; a feature lacking one of the sides is left out.
    """
    groups = list(groups)
    have = [f for f in features if f in df.columns]
    sides = df.where(F.col(side).isin(high, low))
    long = sides.select(
        *groups, side, *[F.col(f).cast("double").alias(f) for f in have]
    ).unpivot([*groups, side], have, "feature_name", "value")
    aucs = grouped_auc(
        long.withColumn("hit", F.col(side) == high), [*groups, "feature_name"], "value", "hit"
    ).where(F.col("auc").isNotNull())
    med = exact_quantiles(sides, [*groups, side], have, [0.5]).withColumnRenamed(
        "metric_name", "feature_name"
    )
    medians = med.groupBy(*groups, "feature_name").agg(
        F.max(F.when(F.col(side) == high, F.col("q0"))).alias("median_high"),
        F.max(F.when(F.col(side) == low, F.col("q0"))).alias("median_low"),
    )
    return null_safe_join(aucs, medians, [*groups, "feature_name"]).select(
        *groups,
        "feature_name",
        (F.col("n_positive") + F.col("n_negative")).alias("n_rows_used"),
        "auc",
        F.greatest(F.col("auc"), 1.0 - F.col("auc")).alias("separability_auc"),
        F.when(F.col("auc") >= 0.5, high).otherwise(low).alias("higher_side"),
        "median_high",
        "median_low",
    )


def threshold_table(rows: DataFrame, thresholds: int = 100) -> DataFrame:
    """Balanced accuracy at evenly spaced cuts of the probability.

    A row only bumps the counter of the last cut it reaches; counts per cut are
    then added up, so no row is compared with every threshold.
    """
    step = 1.0 / (thresholds - 1)
    cuts = [i * step for i in range(thresholds)]
    reached = with_edge_count(rows, "_k", F.col("p"), F.lit(cuts), len(cuts), inclusive=True)
    counts = reached.groupBy("_k").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    grid = rows.sparkSession.createDataFrame(
        [(i + 1, c) for i, c in enumerate(cuts)], "k int, threshold double"
    )
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # thresholds x thresholds rows at most
    hits = (
        grid.join(counts, F.col("_k") >= F.col("k"), "left")
        .groupBy("k", "threshold")
        .agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    )
    positives, negatives = totals.select("P").scalar(), totals.select("N").scalar()
    return hits.select(
        "threshold",
        "tp",
        "fp",
        ((F.col("tp") / positives + (negatives - F.col("fp")) / negatives) / 2.0).alias("balanced_accuracy"),
    )


def best_threshold(table: DataFrame) -> DataFrame:
    """Cut with the best balanced accuracy, the lowest one on a tie."""
    key = F.struct("balanced_accuracy", -F.col("threshold"))
    return table.agg(
        F.max_by("threshold", key).alias("threshold"), F.max("balanced_accuracy").alias("balanced_accuracy")
    )


def label_shares(df: DataFrame, target: str, by=("split_name",)) -> DataFrame:
    """Target distribution per split; with `full` beside the parts."""
    counts = df.groupBy(*by, as_label(F.col(target)).alias("target_label")).agg(F.count("*").alias("n_rows"))
    whole = counts.groupBy("target_label").agg(F.sum("n_rows").alias("n_rows")).withColumn(by[0], F.lit("full"))
    return with_share(counts.unionByName(whole), within=[by[0]])
