"""Skewed inputs against brute force: hot keys, crowded cells, values that fill a third of a group."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysieve import contracts as C
from skysieve.operators import boundary as O
from skysieve.operators import decision as D
from skysieve.operators import frames as FR
from skysieve.operators import layers as L
from skysieve.operators import learning as M
from skysieve.operators import linking as X
from skysieve.operators import ordered
from skysieve.operators import reviews as V
from skysieve.operators import sampling as SM
from skysieve.operators.ordered import (
    exact_quantiles,
    grouped_auc,
    spread_row_number,
    with_buckets,
)
from skysieve.operators.skew import balanced_join, broadcast_ids, with_group_count
from skysieve.plans import bundles as B


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    n = 6000
    value = np.where(rng.random(n) < 0.34, 5.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame(
        {
            "source_id": np.arange(n),
            "g": np.where(rng.random(n) < 0.7, "big", rng.choice(["a", "b"], n)),
            "value": value,
            "hit": rng.random(n) < 0.3,
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(8).cache()


def test_quantiles(skewed):
    pdf, df = skewed
    probs = [0.0, 0.1, 0.5, 0.66, 0.9, 1.0]
    for r in exact_quantiles(df, ["g"], ["value"], probs).collect():
        want = pdf[pdf.g == r.g].value.quantile(probs).tolist()
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want)


def test_quantiles_small_groups(spark):
    rows = [(g, float(v)) for g in range(1, 12) for v in range(g)]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = [0.05, 0.25, 0.5, 0.75, 0.99]
    for r in exact_quantiles(df, ["g"], ["v"], probs).collect():
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(np.arange(r.g), probs))


def test_quantiles_of_wide_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BRACKET_ROWS", 200)
    monkeypatch.setattr(ordered, "CELLS", 256)
    rng = np.random.default_rng(3)
    values = np.concatenate([10 ** rng.uniform(-30, 30, 900), -(10 ** rng.uniform(-3, 300, 300)), np.full(800, 1e-9), [0.0]])
    frame = spark.createDataFrame(pd.DataFrame({"v": values, "w": -values})).repartition(5)
    probs = [0.0, 0.013, 0.25, 0.5, 0.777, 1.0]
    for r in exact_quantiles(frame, [], ["v", "w"], probs).collect():
        want = np.quantile(values if r.metric_name == "v" else -values, probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, rtol=1e-12)
    odd = spark.createDataFrame([(float(v),) for v in [math.inf] * 30 + [-math.inf] * 30 + list(range(41))], "v double")
    row = exact_quantiles(odd, [], ["v"], [0.0, 0.5, 0.9]).first()
    assert (row.q0, row.q1, row.q2) == (-math.inf, 20.0, math.inf)


def test_rows_that_one_task_orders_do_not_grow(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BRACKET_ROWS", 500)
    most, ordered_rows = [], ordered._ordered_values

    def watched(long, ranks, keys):
        most[-1] = max(most[-1], ranks.agg(F.max("_rows")).first()[0] or 0)
        return ordered_rows(long, ranks, keys)

    monkeypatch.setattr(ordered, "_ordered_values", watched)
    for n in (20_000, 200_000):
        most.append(0)
        frame = spark.range(n).select((F.xxhash64("id") / 1e12).alias("v"))
        exact_quantiles(frame, [], ["v"], [i / 10 for i in range(11)]).collect()
    assert max(most) <= 500


def test_quantiles_read_their_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = 4 * ordered.BRACKET_ROWS
    # a few far values, so that the first cells hold too many rows and more turns follow
    frame = spark.range(n).selectExpr("if(id < 3, 1e15, cast(id as double)) as v").mapInArrow(rows, "v double")
    got = exact_quantiles(frame, [], ["v"], [0.25, 0.5]).first()
    want = np.quantile([*range(3, n), *[1e15] * 3], [0.25, 0.5])
    assert [got["q0"], got["q1"]] == pytest.approx(want) and read.value == n


def test_auc(skewed):
    pdf, df = skewed
    for r in grouped_auc(df, ["g"], "value", "hit").collect():
        part = pdf[pdf.g == r.g]
        ranks, p = part.value.rank(), part.hit.sum()
        want = (ranks[part.hit].sum() - p * (p + 1) / 2) / (p * (len(part) - p))
        assert math.isclose(r.auc, want, rel_tol=1e-12)


def test_row_numbers(skewed):
    pdf, df = skewed
    out = spread_row_number(with_buckets(df, ["g"], "value"), ["g"], "_bucket", ["value", "source_id"])
    got = out.toPandas().sort_values(["g", "value", "source_id"])
    assert (got.row_number == got.groupby("g").cumcount() + 1).all()


def test_balanced_join_meets_every_pair_once(spark):
    left = [(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3])]
    right = [(k, i) for i, k in enumerate([1] * 70 + [2] * 2 + [4])]
    ldf, rdf = spark.createDataFrame(left, "k int, l int"), spark.createDataFrame(right, "k int, r int")
    out = balanced_join(ldf, rdf, ["k"], left_spread=F.col("l"), right_spread=F.col("r"), rows_per_task=10)
    got = sorted((x.l, x.r) for x in out.collect())
    assert got == sorted((a, b) for k, a in left for j, b in right if k == j)


def test_sky_match_against_brute_force(spark):
    rng = random.Random(7)
    points = [(i, rng.uniform(0, 360), rng.uniform(-90, 90)) for i in range(300)]
    # crowded spot, the RA wrap, both poles
    points += [(300 + i, 10 + rng.uniform(-1, 1) / 500, 20 + rng.uniform(-1, 1) / 500) for i in range(300)]
    points += [(600 + i, rng.choice([0.0, 359.9999]) + rng.uniform(0, 1e-4), rng.uniform(-0.002, 0.002)) for i in range(100)]
    points += [(700 + i, rng.uniform(0, 360), s * (90 - rng.uniform(0, 0.003))) for i in range(100) for s in (1, -1)]
    ext = [(i, ra % 360, max(-90.0, min(90.0, dec + rng.uniform(-5, 5) / 3600))) for i, ra, dec in points]
    a = spark.createDataFrame(ext, "external_row_id long, ra_deg double, dec_deg double")
    b = spark.createDataFrame(
        [(n, ra % 360, dec) for n, (_, ra, dec) in enumerate(points)], "source_id long, ra double, dec double"
    )
    got = sorted((r.external_row_id, r.source_id) for r in X.sky_match(a.withColumn("external_row_id", F.col("external_row_id")), b, rows_per_task=20).collect())
    e, p = np.radians(np.array(ext)[:, 1:]), np.radians(np.array([(ra % 360, d) for _, ra, d in points]))
    h = np.sin((e[:, None, 1] - p[None, :, 1]) / 2) ** 2 + np.cos(e[:, None, 1]) * np.cos(p[None, :, 1]) * np.sin((e[:, None, 0] - p[None, :, 0]) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, h))))
    want = sorted((int(ext[i][0]), int(j)) for i, j in np.argwhere(sep <= 5 / 3600))
    assert got == want and len(want) > 1000


def test_ranked_matches_with_one_hot_row(spark):
    rng = random.Random(3)
    rows = [(1 if i % 3 == 0 else i, i % 997, rng.randrange(500) / 500 * 6 / 3600) for i in range(3000)]
    df = spark.createDataFrame(rows, "external_row_id long, source_id long, SEPARATION double")
    got = X.rank_matches(df, "b").toPandas().sort_values(["external_row_id", "xmatch_rank"])
    best = {}
    for e, s, d in rows:
        best[(e, s)] = min(d, best.get((e, s), 9))
    want = pd.DataFrame([(e, s, d) for (e, s), d in best.items()], columns=["e", "s", "d"]).sort_values(["e", "d", "s"])
    assert got.external_row_id.tolist() == want.e.tolist() and got.source_id.tolist() == want.s.tolist()
    chosen = {(r.external_row_id, r.source_id) for r in X.best_matches(df, "b").collect()}
    assert chosen == set(map(tuple, got[got.xmatch_selected][["external_row_id", "source_id"]].values.tolist()))


def test_conflict_count_with_hot_source(spark):
    rows = [(i, 5 if i % 3 == 0 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "external_row_id long, source_id long")
    out = X.with_conflict_count(df, rows_per_task=50)
    got = {r.external_row_id: r.source_conflict_count for r in out.collect()}
    ids = pd.Series([s for _, s in rows])
    assert got == dict(zip([e for e, _ in rows], ids.map(ids.value_counts()), strict=True))


def test_split_is_exact_and_stable(spark):
    rows = [(i, "G" if i % 3 else "O", "dwarf" if i % 5 else "evolved") for i in range(1001)]
    df = spark.createDataFrame(rows, "source_id long, spec_class string, evolution_stage string")
    strata = ("spec_class", "evolution_stage")
    first = SM.stratified_split(df, strata).toPandas().set_index("source_id").split_name
    again = SM.stratified_split(df.repartition(5), strata).toPandas().set_index("source_id").split_name
    assert (first.sort_index() == again.sort_index()).all()
    assert (first == "test").sum() == math.ceil(0.3 * 1001)
    folds = SM.stratified_folds(df, "spec_class", C.Protocol(folds=4)).groupBy("spec_class", "fold").count().toPandas()
    assert folds.groupby("spec_class")["count"].agg(lambda c: c.max() - c.min()).max() <= 1


def test_split_guards(spark):
    schema = "source_id long, spec_class string"
    with pytest.raises(ValueError, match="two rows"):
        SM.stratified_split(spark.createDataFrame([(1, "G"), (2, "G"), (3, "K")], schema), ("spec_class",))
    with pytest.raises(ValueError, match="empty"):
        SM.stratified_split(spark.createDataFrame([], schema), ("spec_class",))
    many = spark.createDataFrame([(i, str(i // 2)) for i in range(20)], schema)
    with pytest.raises(ValueError, match="too small"):
        SM.stratified_split(many, ("spec_class",))


def test_field_sample_guard(spark):
    schema = "source_id long, spec_class string, evolution_stage string"
    hosts = spark.createDataFrame([(i, "G", "dwarf") for i in range(5)], schema)
    pool = spark.createDataFrame([(100 + i, "G", "dwarf") for i in range(4)], schema)
    with pytest.raises(ValueError, match="5 needed"):
        SM.matched_field_sample(pool, hosts)


def test_membership_conflict(spark):
    cols = "source_id long, domain_target string, ood_group string, " + ", ".join(f"{c} double" for c in C.CORE_FEATURES)
    row = [1.0] * len(C.CORE_FEATURES)
    df = spark.createDataFrame([(1, "id", None, *row), (1, "OOD", "x", *row)], cols)
    with pytest.raises(ValueError, match="source_id: 1"):
        FR.ood_frame(df)


def test_cohort_never_broadcasts_star_tables(spark):
    ids = spark.range(40).withColumnRenamed("id", "source_id")
    ranking = ids.selectExpr(
        "source_id", "CASE WHEN source_id % 4 = 0 THEN 'high' ELSE 'low' END AS priority_label", "source_id / 40 AS priority_score",
        "1E0 AS host_similarity_score", "2E0 AS observability_score",
    )
    decisions = ids.selectExpr(
        "source_id", "'id' AS final_domain_state", "'pass' AS final_quality_state", "'G' AS final_coarse_class",
        "'G2' AS final_refinement_label", "'x' AS final_decision_reason",
    )
    inputs = ids.selectExpr("source_id", *[f"CAST(source_id AS DOUBLE) AS {c}" for c in V.COHORT_PHYSICS])
    cohort = V.high_cohort(ranking, decisions, inputs)
    for df in (cohort, V.add_new(ranking, decisions)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    row = V.cohort_summary(cohort, ranking, decisions).first()
    assert (row.n_rows, row.share_final_id, row.median_ruwe, row.median_priority_score) == (10, 0.25, 18.0, 0.45)


def test_joins_of_star_tables_never_broadcast(spark):
    ids = spark.range(30).withColumnRenamed("id", "source_id")
    scored = ids.selectExpr("source_id", "'G' AS coarse_predicted_label", "9E-1 AS coarse_probability_max", "5E-1 AS coarse_probability_margin")
    rows = D.family_rows(ids, scored, "G", C.HandoffPolicy())
    outcome = ids.selectExpr(
        "source_id", "'id' AS final_domain_state", "'pass' AS final_quality_state", "'g ' AS final_coarse_class",
        *[f"'x' AS {c}" for c in ("final_coarse_confidence", "final_refinement_label", "final_refinement_state", "final_refinement_confidence", "final_decision_reason")],
    )
    reasons = ids.selectExpr("source_id", *[f"'x' AS {c}" for c in ("quality_reason", "review_bucket", "ood_state", "ood_reason")])
    chosen = D.priority_input(ids.withColumn("host_similarity_score", F.lit(0.5)), outcome, check=False)
    enriched = L.enrich(ids, ids.withColumn("radius_flame", F.lit(1.0)).where("source_id % 2 = 0"), "radius_flame")
    for df in (rows, chosen, enriched, O.final_outcomes(ids, outcome, reasons)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and df.count() == 30
    assert enriched.where("radius_flame IS NULL").count() == 15


def test_rows_are_counted_from_a_written_table(spark):
    slow = spark.range(60).withColumn("k", F.udf(lambda i: i % 3, "long")("id"))
    got = with_group_count(slow, "k", "n", spread=F.col("id"), rows_per_task=7)
    assert "EvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # the rows were made twice
    assert sorted((r.id, r.k, r.n) for r in got.collect()) == [(i, i % 3, 20) for i in range(60)]


def test_few_members_never_shuffle_wide_rows(spark):
    names = (*C.CORE_FEATURES, "radius_flame", "ruwe", "parallax_over_error", "classprob_dsc_combmod_star")
    stars = spark.range(30).selectExpr("id AS source_id", "0 AS non_single_star", *[f"1E0 AS {c}" for c in dict.fromkeys(names)])
    members = spark.range(6).selectExpr("CASE WHEN id < 5 THEN id % 2 END AS source_id")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the estimate were too large
    try:
        gated = L.initial_gate(stars, members)
        plan = gated._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.source_id for r in gated.where("in_ood_reference").collect()) == [0, 1] and gated.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    many = stars.join(broadcast_ids(members.distinct(), limit=2).withColumn("known", F.lit(True)), "source_id", "left")
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 30


def test_many_members_shuffle_narrow_rows(spark, tmp_path, monkeypatch):
    spark.range(30).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'x' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "TIMESTAMP'2020-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(6).selectExpr(
        "id AS event_id", "TIMESTAMP'2020-01-01' AS ts", "CASE WHEN id < 5 THEN id % 2 END AS user_id", "'a' AS event_type",
        "1E0 AS value", "'' AS props",
    ).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(L, "broadcast_ids", lambda ids: broadcast_ids(ids, limit=1))
    gated = B.gated(spark, str(tmp_path))
    plan = gated._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(o_orderkey")
    assert "SortMergeJoin" in plan[0] and len(plan) > 1
    assert all(f"{c}#" not in x for x in plan[1:] for c in ("parallax", "raw_sptype", "quality_state", "o_custkey"))
    assert sorted(r.source_id for r in gated.where("in_ood_reference").collect()) == [0, 1] and gated.count() == 30


def test_merged_ranking_is_never_broadcast(spark):
    decisions = spark.range(20).selectExpr("id AS source_id", "CAST(NULL AS STRING) AS priority_state")
    ranking = spark.range(5).selectExpr("CAST(id AS STRING) AS source_id", "'high' AS priority_label")
    merged = D.merge_priority(decisions, ranking)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert merged.count() == 20 and merged.where("priority_state = 'high'").count() == 5


def test_every_core_has_a_share_of_a_network_fit(spark, monkeypatch):
    seen, fit_network = [], M._fit_network

    def watched(ready, *rest):
        seen.extend(r["count"] for r in ready.groupBy(F.spark_partition_id()).count().collect())
        return fit_network(ready, *rest)

    monkeypatch.setattr(M, "_fit_network", watched)
    features = [f"CAST(id % {7 + i} AS DOUBLE) AS {c}" for i, c in enumerate(C.COARSE_TASK.features)]
    rows = spark.range(0, 4000, 1, 1).selectExpr("IF(id % 7 < 3, 'G', 'K') AS spec_class", *features)
    model = M.fit(rows, C.COARSE_TASK, M.ModelSpec("network", iterations=40))
    cores = spark.sparkContext.defaultParallelism
    assert sum(seen) == 4000 and len(seen) >= cores and max(seen) * cores <= 2 * 4000
    scored = M.score(rows, model)
    assert scored.where("predicted_spec_class = spec_class").count() > 3600
