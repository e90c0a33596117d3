"""Every registered query of the evaluation library and its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores as S
from .functions import stats, text
from .operators import acceptance, crossrun, explore, grid, moderation, order_stats, plugins, review, rollup, scoring, similarity
from .plans import tables as T
from .plans.evaluation import evaluate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = S.GateConfig(hard_gates={"safety": 0.1})
ROLLED = f"WITH {T.IMAGES}, {T.COMPOSITE}, {T.GATED}, {T.GROUPS}, {T.ROLLED}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _gated(spark, d):
    return rollup.gate(T.images(spark, d), CONFIG)


def _r(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded for comparison: sums differ in their last bits with the order of rows."""
    return df.withColumns({n: F.round(n, 9) for n in names})


# -- scores ----------------------------------------------------------------------


@query(f"WITH {T.IMAGES}, {T.COMPOSITE}, {T.GATED} SELECT run_id, round(composite, 9) AS composite, passed, count(*) AS n FROM gated GROUP BY ALL")
def gate_decision(spark, d):
    return _r(_gated(spark, d), "composite").groupBy("run_id", "composite", "passed").agg(F.count("*").alias("n"))


@query(f"""WITH {T.IMAGES}, r AS (SELECT run_id, unnest(list_filter([CASE WHEN identity < 0.2 THEN 'identity_mismatch' END, CASE WHEN clip_score < 0.1 THEN 'prompt_mismatch' END, CASE WHEN safety < 0.1 THEN 'unsafe' END], lambda x: x IS NOT NULL)) AS code FROM images)
SELECT run_id, code, count(*) AS n FROM r GROUP BY ALL""")  # fmt: skip
def hard_gate_reasons(spark, d):
    reasons = S.hard_reasons(S.GateConfig(hard_gates={"identity": 0.2, "clip_score": 0.1, "safety": 0.1}))
    return T.images(spark, d).select("run_id", F.explode(reasons).alias("r")).groupBy("run_id", F.col("r.code").alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {T.IMAGES} SELECT run_id, round(avg((2 * identity + coalesce(clip_score, 0) + 0.5 * coalesce(preference, 0)) / (2.0 + CASE WHEN clip_score IS NULL THEN 0 ELSE 1 END + CASE WHEN preference IS NULL THEN 0 ELSE 0.5 END)), 9) AS composite
FROM images GROUP BY run_id""")  # fmt: skip
def composite_renorm(spark, d):
    config = S.GateConfig(weights={"identity": 2.0, "clip_score": 1.0, "preference": 0.5, "safety": 0.0, "sharpness": 3.0})
    return T.images(spark, d).groupBy("run_id").agg(F.round(F.avg(S.composite(config)), 9).alias("composite"))


@query("""SELECT o_orderkey AS id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (o_totalprice - 1000) / 300000.0)), 9) AS normal, CASE WHEN o_totalprice >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS step FROM orders""")
def normalize_clamp(spark, d):
    return T.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(S.linear_normalize(F.col("o_totalprice"), 1000, 301000), 9).alias("normal"), S.linear_normalize(F.col("o_totalprice"), 5, 5).cast("double").alias("step"))


@query("SELECT o_orderkey % 1000 AS n, o_orderkey % 1000 - (o_orderkey % 7) * (o_orderkey % 1000) // 7 AS k, " + ", ".join(f"round({e}, 9) AS {n}" for e, n in zip(T.wilson_sql("(o_orderkey % 1000 - (o_orderkey % 7) * (o_orderkey % 1000) // 7)", "(o_orderkey % 1000)"), ("ci_low", "ci_high"), strict=True)) + " FROM orders")
def wilson_ci(spark, d):
    n = F.col("o_orderkey") % 1000
    k = n - F.floor((F.col("o_orderkey") % 7) * n / 7)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return T.read(spark, d, "orders").select(n.alias("n"), k.alias("k")).select("n", "k", F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


# -- groups and runs -------------------------------------------------------------


@query(f"WITH {T.IMAGES}, {T.COMPOSITE}, {T.GATED}, {T.GROUPS} SELECT run_id, best, count(*) AS n FROM groups GROUP BY ALL")
def group_outcome(spark, d):
    rows = rollup.group_outcomes(_gated(spark, d))
    alone = F.col("duplicate_group").isNull()
    counts = F.array(*[F.struct(F.lit(b).alias("best"), F.when(alone, n).otherwise(F.when(F.col("best") == b, 1).otherwise(0)).cast("long").alias("n")) for b, n in ((2, F.col("n_pass")), (1, F.col("n_open")), (0, F.col("n_images") - F.col("n_pass") - F.col("n_open")))])
    return rows.select("run_id", F.explode(counts).alias("c")).select("run_id", "c.best", "c.n").groupBy("run_id", "best").agg(F.sum("n").alias("n")).where("n > 0")


@query(f"{ROLLED} SELECT run_id, n_images, n_groups, n_passed, n_needs_hitl, round(pass_rate, 9) AS pass_rate FROM rolled")
def run_rollup(spark, d):
    return _r(rollup.roll_up(_gated(spark, d)).select("run_id", "n_images", "n_groups", "n_passed", "n_needs_hitl", "pass_rate"), "pass_rate")


@query(f"{ROLLED} SELECT run_id, " + ", ".join(f"round(mean_{m}, 9) AS mean_{m}" for m in S.METRICS) + " FROM rolled")
def metric_means(spark, d):
    names = [f"mean_{m}" for m in S.METRICS]
    return _r(rollup.roll_up(_gated(spark, d)).select("run_id", *names), *names)


_LOW, _HIGH = T.wilson_sql("n_passed", "n_groups")
_RUNS = f"{ROLLED}, runs AS (SELECT *, pass_rate >= 0.75 AS run_passed, pass_rate < 0.75 AND n_needs_hitl > 0 AND (n_passed + n_needs_hitl) / n_groups::DOUBLE >= 0.75 AS pending, {_LOW} AS ci_low, {_HIGH} AS ci_high FROM rolled)"


@query(f"{_RUNS} SELECT run_id, n_images, n_groups, n_passed, n_needs_hitl, round(pass_rate, 9) AS pass_rate, run_passed, pending, round(unsafe_rate, 9) AS unsafe_rate, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM runs")
def run_verdicts(spark, d):
    out = evaluate(T.images(spark, d), CONFIG)
    return _r(out.select("run_id", "n_images", "n_groups", "n_passed", "n_needs_hitl", "pass_rate", "run_passed", "pending", "unsafe_rate", "ci_low", "ci_high"), "pass_rate", "unsafe_rate", "ci_low", "ci_high")


@query(f"{_RUNS} SELECT CASE WHEN run_passed THEN 'passed' WHEN pending THEN 'needs_review' ELSE 'failed' END AS verdict, count(*) AS n FROM runs GROUP BY ALL")
def verdict_pending(spark, d):
    runs = rollup.verdicts(rollup.roll_up(_gated(spark, d)))
    label = S.verdict_label(F.when(F.col("run_passed"), True).when(~F.col("pending"), False))
    return runs.groupBy(label.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {T.IMAGES} SELECT run_id, max(CASE WHEN safety < 0.5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS any_hit, round(count(*) FILTER (safety < 0.5) / count(safety)::DOUBLE, 9) AS hit_rate, round(min(safety), 9) AS safety_min, round(quantile_cont(safety, 0.05), 9) AS safety_p05 FROM images GROUP BY run_id""")
def safety_tail(spark, d):
    return _r(rollup.safety_tail(T.images(spark, d)), "hit_rate", "safety_min", "safety_p05")


@query("SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL")
def percentile_tail(spark, d):
    out = order_stats.percentiles(T.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.05, 0.95], ["p05", "p95"])
    return out.withColumns({p: F.round(p, 6) for p in ("p05", "p95")})


@query(f"{ROLLED} SELECT run_id, round(unsafe_rate, 9) AS unsafe_rate FROM rolled")
def unsafe_rate(spark, d):
    return _r(acceptance.unsafe_rate(_gated(spark, d)), "unsafe_rate")


@query(f"""{_RUNS}, checks AS (SELECT run_id, unnest([{{'ord': 1, 'name': 'pass_rate', 'actual': pass_rate, 'passed': pass_rate >= 0.5}}, {{'ord': 2, 'name': 'pass_rate_ci_lower', 'actual': ci_low, 'passed': ci_low >= 0.2037}},
 {{'ord': 3, 'name': 'identity_mean', 'actual': mean_identity, 'passed': mean_identity >= 0.5037}}, {{'ord': 4, 'name': 'unsafe_rate', 'actual': unsafe_rate, 'passed': unsafe_rate <= 0.5}}]) AS c FROM runs)
SELECT run_id, c.ord AS ord, c.name AS name, round(c.actual, 9) AS actual, c.passed AS passed FROM checks""")  # fmt: skip
def acceptance_checks(spark, d):
    found = acceptance.acceptance(evaluate(T.images(spark, d), CONFIG), acceptance.Thresholds(0.5, 0.2037, 0.5037, 0.5))
    return _r(found.drop("threshold", "detail"), "actual")


@query(f"""{_RUNS}, fired AS (SELECT run_id, unnest(list_filter([
 CASE WHEN unsafe_rate > 0.6 THEN {{'ord': 0, 'stage': 'lens', 'metric': 'unsafe_rate', 'value': unsafe_rate}} END, CASE WHEN mean_identity < 0.5037 THEN {{'ord': 1, 'stage': 'forge', 'metric': 'identity', 'value': mean_identity}} END,
 CASE WHEN mean_clip_score < 0.4037 THEN {{'ord': 2, 'stage': 'lens', 'metric': 'clip_score', 'value': mean_clip_score}} END, CASE WHEN mean_clip_score < 0.4037 THEN {{'ord': 3, 'stage': 'grid', 'metric': 'clip_score', 'value': mean_clip_score}} END,
 CASE WHEN mean_aesthetic < 0.3037 THEN {{'ord': 4, 'stage': 'forge', 'metric': 'aesthetic', 'value': mean_aesthetic}} END, CASE WHEN mean_preference < 0.5037 THEN {{'ord': 5, 'stage': 'forge', 'metric': 'preference', 'value': mean_preference}} END,
 CASE WHEN pending THEN {{'ord': 7, 'stage': 'refine', 'metric': 'pass_rate', 'value': pass_rate}} END], lambda x: x IS NOT NULL)) AS r FROM runs)
SELECT run_id, r.ord AS ord, r.stage AS stage, r.metric AS metric, round(r.value, 9) AS value FROM fired""")  # fmt: skip
def recommend_rules(spark, d):
    floors = acceptance.Floors(max_unsafe_rate=0.6, min_identity=0.5037, min_clip_score=0.4037, min_aesthetic=0.3037, min_preference=0.5037)
    return _r(acceptance.recommend(evaluate(T.images(spark, d), CONFIG), floors).drop("issue", "action", "threshold"), "value")


@query(f"""{_RUNS} SELECT run_id, 'pass_rate ' || format('{{:.2f}}', pass_rate) || ' vs threshold 0.75 — ' || CASE WHEN run_passed THEN 'passed' WHEN pending THEN 'pending review' ELSE 'failed' END
 || ' (' || n_passed || '/' || n_groups || ' groups passed, ' || n_needs_hitl || ' need review)' AS reasons FROM runs""")
def verdict_reasons(spark, d):
    runs = rollup.verdicts(rollup.roll_up(_gated(spark, d)))
    return runs.select("run_id", F.array_join(rollup.verdict_reasons(runs), "; ").alias("reasons"))


@query(f"""WITH {T.IMAGES}, {T.COMPOSITE}, {T.GATED}, r AS (SELECT run_id, unnest(CASE WHEN safety < 0.1 OR identity < 0.2 THEN list_filter([CASE WHEN identity < 0.2 THEN 'identity ' || format('{{:.3f}}', identity) || ' < hard gate 0.200' END,
 CASE WHEN safety < 0.1 THEN 'safety ' || format('{{:.3f}}', safety) || ' < hard gate 0.100' END], lambda x: x IS NOT NULL) WHEN composite <= 0.4 THEN ['low composite'] END) AS note FROM gated) SELECT run_id, note, count(*) AS n FROM r GROUP BY ALL""")
def gate_notes(spark, d):
    """Notes of failed images; the composite's own digits are left out, for its sums differ in their last bits."""
    config = S.GateConfig(hard_gates={"identity": 0.2, "safety": 0.1})
    rows = rollup.gate(T.images(spark, d), config).select("run_id", F.explode(S.notes(config)).alias("note"))
    return rows.withColumn("note", F.when(F.col("note").startswith("composite"), "low composite").otherwise(F.col("note"))).groupBy("run_id", "note").agg(F.count("*").alias("n"))


@query(f"""{_RUNS}, c AS (SELECT run_id, unnest([{{'ord': 1, 'detail': 'pass_rate ' || format('{{:.3f}}', pass_rate) || CASE WHEN pass_rate >= 0.5 THEN ' >= ' ELSE ' < ' END || '0.500'}},
 {{'ord': 2, 'detail': '95% Wilson lower bound ' || format('{{:.3f}}', ci_low) || ' (' || n_passed || '/' || n_groups || ')' || CASE WHEN ci_low >= 0.2037 THEN ' >= ' ELSE ' < ' END || '0.204'}},
 {{'ord': 3, 'detail': 'identity not measured'}}, {{'ord': 4, 'detail': 'unsafe rate ' || format('{{:.3f}}', unsafe_rate) || CASE WHEN unsafe_rate <= 0.5 THEN ' <= ' ELSE ' > ' END || '0.500'}}]) AS c FROM runs) SELECT run_id, c.ord AS ord, c.detail AS detail FROM c""")
def acceptance_details(spark, d):
    runs = evaluate(T.images(spark, d), CONFIG).withColumn("mean_identity", F.lit(None).cast("double"))
    return acceptance.acceptance(runs, acceptance.Thresholds(0.5, 0.2037, 0.5037, 0.5)).select("run_id", "ord", "detail")


@query(f"""{_RUNS} SELECT run_id, 0 AS ord, 'unsafe outputs' AS issue, 'filter/re-caption training data to remove unsafe content' AS action, 0.6::DOUBLE AS threshold FROM runs WHERE unsafe_rate > 0.6
UNION ALL SELECT run_id, 4, 'technical/aesthetic quality low', 'revisit training config (learning rate / steps) or the base checkpoint', 0.3037 FROM runs WHERE mean_aesthetic < 0.3037
UNION ALL SELECT run_id, 7, 'borderline results awaiting review', 'run a HITL review on the needs-review band before deciding', NULL FROM runs WHERE pending""")
def recommend_texts(spark, d):
    floors = acceptance.Floors(max_unsafe_rate=0.6, min_identity=None, min_clip_score=None, min_aesthetic=0.3037)
    return acceptance.recommend(evaluate(T.images(spark, d), CONFIG), floors).select("run_id", "ord", "issue", "action", "threshold")


@query(f"{_RUNS} SELECT run_id, n_images, run_passed, pending, count(*) AS n FROM runs GROUP BY ALL")
def report_digest(spark, d):
    runs = rollup.verdicts(rollup.roll_up(_gated(spark, d)))
    return runs.select("run_id", "n_images", "run_passed", "pending").groupBy("run_id", "n_images", "run_passed", "pending").agg(F.count("*").alias("n"))


# -- cross-run -------------------------------------------------------------------

_STORE = f"{ROLLED}, store AS (SELECT r.*, o_orderpriority AS base_checkpoint, o_orderstatus AS step_config, CASE WHEN o_custkey % 5 > 0 THEN round((o_custkey % 5) / 4.0::DOUBLE, 4) END AS lora_weight FROM rolled r JOIN orders ON o_orderkey = run_id)"


def _store(spark, d):
    orders = T.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("base_checkpoint"), F.col("o_orderstatus").alias("step_config"),
        F.when(F.col("o_custkey") % 5 > 0, F.round((F.col("o_custkey") % 5) / 4.0, 4)).alias("lora_weight"), F.to_json(F.struct((F.col("o_custkey") % 3).cast("string").alias("arm"))).alias("labels"),
    )
    return rollup.roll_up(_gated(spark, d)).join(orders, "run_id")


def _slice_sql(value: str, head: str = _STORE) -> str:
    low, high = T.wilson_sql("n_passed", "n_groups")
    return f"""{head}, cells AS (SELECT {value} AS value, count(*) AS n_runs, sum(n_groups)::BIGINT AS n_groups, sum(n_passed)::BIGINT AS n_passed FROM store GROUP BY ALL),
slices AS (SELECT value, n_runs, n_groups, n_passed, n_passed / n_groups::DOUBLE AS pass_rate, {low} AS ci_low, {high} AS ci_high FROM cells),
ranked AS (SELECT *, row_number() OVER (ORDER BY ci_low DESC, pass_rate DESC, value NULLS FIRST) AS place FROM slices)
SELECT value, n_runs, n_groups, n_passed, round(pass_rate, 9) AS pass_rate, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high, place FROM ranked"""


def _slice(spark, d, dimension):
    return _r(crossrun.slice_pass_rate(_store(spark, d), dimension).drop("dimension", "text"), "pass_rate", "ci_low", "ci_high")


@query(_slice_sql("base_checkpoint"))
def slice_checkpoint(spark, d):
    return _slice(spark, d, "base_checkpoint")


@query(_slice_sql("step_config"))
def slice_step_config(spark, d):
    return _slice(spark, d, "step_config")


@query(_slice_sql("lora_weight"))
def slice_weight_null_cell(spark, d):
    return _slice(spark, d, "lora_weight")


@query(_slice_sql("(SELECT (o_custkey % 3)::VARCHAR FROM orders WHERE o_orderkey = run_id)"))
def slice_label_json(spark, d):
    return _slice(spark, d, "label:arm")


# A factor that the outcome depends on: the run's mean identity, in quarters.
_SPLIT = _STORE.replace("CASE WHEN o_custkey % 5 > 0 THEN round((o_custkey % 5) / 4.0::DOUBLE, 4) END AS lora_weight", "CASE WHEN n_images > 1 THEN floor(round(mean_identity, 9) * 4) / 4 END AS lora_weight")
_BEST = _slice_sql("lora_weight", _SPLIT).rpartition("ranked AS")[0] + "r2 AS (SELECT *, row_number() OVER (ORDER BY ci_low DESC, pass_rate DESC, value) AS p FROM slices WHERE value IS NOT NULL)"


def _split_store(spark, d):
    return _store(spark, d).withColumn("lora_weight", F.when(F.col("n_images") > 1, F.floor(F.round("mean_identity", 9) * 4) / 4))


@query(_BEST + " SELECT a.value AS value, round(a.ci_low, 9) AS ci_low FROM r2 a JOIN r2 b ON a.p = 1 AND b.p = 2 AND a.ci_low > b.ci_high")
def best_cell(spark, d):
    return _r(crossrun.clear_winner(crossrun.slice_pass_rate(_split_store(spark, d), "lora_weight")).select("value", "ci_low"), "ci_low")


@query(_BEST + """ SELECT 9 AS ord, 'weight' AS stage, 'lora_weight outcome varies across runs' AS issue, 'prefer lora_weight=' || chr(39) || a.value || chr(39) || ' (highest evidence-adjusted pass-rate, lower bound ' || format('{:.2f}', a.ci_low) || ')' AS action,
 'pass_rate' AS metric, round(a.pass_rate, 9) AS value FROM r2 a JOIN r2 b ON a.p = 1 AND b.p = 2 AND a.ci_low > b.ci_high""")
def recommend_store(spark, d):
    return _r(acceptance.recommend_from_store(_split_store(spark, d)).where("stage = 'weight'").drop("threshold"), "value")


@query(_slice_sql("CASE lora_weight WHEN 0.25 THEN '0.000125' WHEN 0.5 THEN '0.00025' WHEN 0.75 THEN '0.000375' WHEN 1 THEN '0.0005' END"))
def slice_weight_text(spark, d):
    """Small weights as the reports write them, not as 1.25E-4; null stays a cell of its own."""
    store = _store(spark, d).withColumn("lora_weight", F.col("lora_weight") / 2000)
    cells = crossrun.slice_pass_rate(store, "lora_weight").withColumn("value", F.col("text"))
    return _r(cells.drop("dimension", "text"), "pass_rate", "ci_low", "ci_high")


@query(f"""{ROLLED}, tails AS (SELECT run_id, min(safety) AS safety_min, count(*) FILTER (safety < 0.5) / count(safety)::DOUBLE AS hit FROM images GROUP BY run_id),
s AS (SELECT *, {_LOW} AS lo, {_HIGH} AS hi FROM rolled JOIN tails USING (run_id) JOIN orders ON o_orderkey = run_id)
SELECT run_id, 't' || (o_custkey % 10) AS training_run_id, o_orderpriority AS base_checkpoint, 'sha-' || o_orderpriority AS base_checkpoint_sha, CASE o_custkey % 3 WHEN 1 THEN 'one' WHEN 2 THEN 'one+two' END AS lora,
 CASE o_custkey % 3 WHEN 1 THEN 'sha-one' END AS lora_sha, CASE o_custkey % 3 WHEN 1 THEN 0.6667 END::DOUBLE AS lora_weight, 'p' || o_custkey AS prompt, n_images, n_groups, n_passed, n_needs_hitl, round(pass_rate, 9) AS pass_rate,
 round(lo, 9) AS pass_rate_ci_low, round(hi, 9) AS pass_rate_ci_high, round((o_orderkey % 7) / 7.0::DOUBLE, 9) AS diversity, round(safety_min, 9) AS safety_min, round(hit, 9) AS safety_hit_rate,
 '1.3' AS proof_version, CASE o_custkey % 2 WHEN 1 THEN 'clip@2,plain' END AS scorers, NULL::VARCHAR AS created_at, o_orderstatus AS step_config, '{{"arm":"' || (o_custkey % 3) || '"}}' AS labels FROM s""")
def run_stats(spark, d):
    """All 23 columns of the cross-run store; an order is a run and says what made it."""
    orders = T.read(spark, d, "orders")
    key = F.col("o_custkey")
    lora = F.struct(F.lit("one").alias("name"), F.lit("sha-one").alias("sha256"), F.lit(2 / 3).alias("weight"))
    other = F.struct(F.lit("two").alias("name"), F.lit("sha-two").alias("sha256"), F.lit(0.5).alias("weight"))
    loras = F.when(key % 3 == 1, F.array(lora)).when(key % 3 == 2, F.array(lora, other)).otherwise(F.array().cast("array<struct<name:string,sha256:string,weight:double>>"))
    manifests = orders.select(
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("t"), (key % 10).cast("string")).alias("training_run_id"), F.struct(F.col("o_orderpriority").alias("name"), F.concat(F.lit("sha-"), "o_orderpriority").alias("sha256")).alias("base_checkpoint"),
        loras.alias("loras"), F.concat(F.lit("p"), key.cast("string")).alias("prompt"), F.lit(None).cast("string").alias("created_at"), F.col("o_orderstatus").alias("step_config"), F.to_json(F.struct((key % 3).cast("string").alias("arm"))).alias("labels"),
    )
    scorers = F.when(key % 2 == 1, F.array(F.struct(F.lit("clip").alias("name"), F.lit("2").alias("version")), F.struct(F.lit("plain").alias("name"), F.lit(None).cast("string").alias("version"))))
    reports = orders.select(F.col("o_orderkey").alias("run_id"), ((F.col("o_orderkey") % 7) / 7).alias("diversity"), F.lit("1.3").alias("proof_version"), scorers.alias("scorers"))
    rolled = rollup.roll_up(_gated(spark, d)).join(reports, "run_id")
    return _r(crossrun.run_stats(manifests, rolled, rollup.safety_tail(T.images(spark, d))), "pass_rate", "pass_rate_ci_low", "pass_rate_ci_high", "diversity", "safety_min", "safety_hit_rate")


@query("""WITH log AS (SELECT o_custkey AS run_id, o_totalprice AS pass_rate, o_orderdate AS batch, o_orderkey AS ord FROM orders)
SELECT run_id, arg_max(pass_rate, (batch, ord)) AS pass_rate, max((batch, ord))[2] AS ord FROM log GROUP BY run_id""")
def upsert_latest(spark, d):
    log = T.read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_totalprice").alias("pass_rate"), F.col("o_orderdate").alias("batch"), F.col("o_orderkey").alias("ord"))
    return crossrun.latest(log, "batch", "ord").drop("batch")


@query("""SELECT c_custkey AS run_id, c_acctbal AS score, c_mktsegment AS labels FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT s_suppkey AS run_id, s_acctbal AS score, NULL AS labels FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""")
def schema_union(spark, d):
    old = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").alias("score"))
    new = T.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("labels"))
    return crossrun.append(old, new, 1).select("run_id", "score", "labels")


@query("""WITH b AS (SELECT o_custkey AS run_id, o_orderpriority AS batch, count(*) AS n_images, max(o_totalprice) AS best, min(CASE WHEN o_orderpriority >= '3' THEN o_orderdate END)::VARCHAR AS labels FROM orders GROUP BY ALL),
r AS (SELECT run_id, n_images, best, labels FROM b QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY batch DESC) = 1)
SELECT r.run_id, n_images, CASE WHEN c_custkey IS NULL THEN best ELSE c_acctbal END AS best, labels FROM r LEFT JOIN customer ON c_custkey = r.run_id AND c_mktsegment = 'MACHINERY'""")  # fmt: skip
def snapshot_store(spark, d):
    """A customer is a run, evaluated once for each priority of its orders; each is a commit, of which the later ones have a column more. Then some runs are reviewed in one update, and a repeated append counts once."""
    from uuid import uuid4

    from .sources.shared import shared_folder
    from .sources.snapshots import SnapshotStore

    store = SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid4().hex}", merged_after=4)
    orders = T.read(spark, d, "orders")
    # The five priorities of orders.
    for number, priority in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")):
        batch = orders.where(F.col("o_orderpriority") == priority).groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("n_images"), F.max("o_totalprice").alias("best"), F.min("o_orderdate").cast("string").alias("labels"))
        for _ in range(2):
            store.append(batch if number > 1 else batch.drop("labels"), source=("evaluation", number))
    reviews = T.read(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("reviewed"))
    # Runs of every id may be touched, so none are named.
    store.update(None, lambda rows: rows.join(reviews, "run_id").withColumn("best", F.col("reviewed")).drop("reviewed"))
    return store.current()


# -- review ----------------------------------------------------------------------

_PASSED = "CASE WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN false END"


def _reviewed(spark, d):
    """An order is an image; events are reviews, 2000 users at most wide, in daily batches."""
    orders = T.read(spark, d, "orders")
    passed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    images = orders.select((F.col("o_custkey") % 10).alias("run_id"), F.col("o_orderkey").alias("image_id"), passed.alias("passed"))
    ev = T.read(spark, d, "events")
    codes = F.when(F.col("event_id") % 11 == 0, F.array(F.lit("anatomy"))).otherwise(F.array().cast("array<string>"))
    updates = ev.join(orders.select(F.col("o_orderkey").alias("user_id"), "o_custkey"), "user_id").select(
        (F.col("o_custkey") % 10).alias("run_id"), F.col("user_id").alias("image_id"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("batch"), F.col("event_id").alias("ord"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("r"), (F.col("event_id") % 5).cast("string"))).alias("rater"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 5 + 1).cast("int")).alias("hitl_rating"), codes.alias("reject_codes"),
    )
    return images, updates


_REVIEW = f"""WITH im AS (SELECT o_custkey % 10 AS run_id, o_orderkey AS image_id, {_PASSED} AS passed FROM orders),
u AS (SELECT user_id AS image_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS batch, event_id AS ord, CASE WHEN event_id % 3 > 0 THEN 'r' || (event_id % 5) END AS rater,
  CASE WHEN event_id % 4 > 0 THEN (event_id % 5 + 1)::INT END AS hitl_rating, event_id % 11 = 0 AS rejects FROM events SEMI JOIN im ON image_id = user_id),
l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY image_id, batch ORDER BY ord DESC) = 1),
dec AS (SELECT *, CASE WHEN rejects THEN false WHEN hitl_rating IS NOT NULL THEN hitl_rating >= 3 END AS decision FROM l),
st AS (SELECT image_id, arg_max(decision, batch) FILTER (decision IS NOT NULL) AS decision, arg_max_null(hitl_rating, batch) AS hitl_rating, arg_max(rater, batch) FILTER (rater IS NOT NULL) AS hitl_rater, arg_max(rejects, batch) AS rejects FROM dec GROUP BY image_id)"""


@query(f"{_REVIEW} SELECT im.run_id, im.image_id, coalesce(decision, passed) AS passed, hitl_rating, hitl_rater FROM im LEFT JOIN st USING (image_id)")
def hitl_fold(spark, d):
    return review.apply_reviews(*_reviewed(spark, d)).select("run_id", "image_id", "passed", "hitl_rating", "hitl_rater")


@query(f"{_REVIEW} SELECT u.image_id, u.ord FROM u LEFT JOIN im ON u.image_id = im.image_id AND im.passed WHERE im.image_id IS NULL")
def stray_updates(spark, d):
    return review.stray_updates(*_reviewed(spark, d)).select("image_id", "ord")


def _refinements(spark, d):
    images, updates = _reviewed(spark, d)
    ranks = updates.withColumns({"rank": F.when(F.col("ord") % 6 > 0, (F.col("ord") % 5 + 1).cast("int")), "notes": F.when(F.col("ord") % 2 > 0, F.col("ord").cast("string"))})
    return images, ranks.select("run_id", "image_id", "batch", "ord", "rater", "rank", "notes")


_REFINE = _REVIEW.rpartition("dec AS")[0] + """rf AS (SELECT image_id, batch, rater, CASE WHEN ord % 6 > 0 THEN (ord % 5 + 1)::INT END AS rank, CASE WHEN ord % 2 > 0 THEN ord::VARCHAR END AS notes FROM l),
cl AS (SELECT image_id, coalesce(max(batch) FILTER (rank IS NULL), -1) AS cleared FROM rf GROUP BY image_id),
st AS (SELECT image_id, arg_max(rank, batch) AS rank, arg_max(notes, batch) FILTER (notes IS NOT NULL) AS notes FROM rf JOIN cl USING (image_id) WHERE batch > cleared GROUP BY image_id)"""


@query(f"{_REFINE} SELECT im.image_id, CASE WHEN passed THEN rank END AS rank, CASE WHEN passed THEN notes END AS notes FROM im LEFT JOIN st USING (image_id)")
def refine_merge(spark, d):
    return review.apply_refinements(*_refinements(spark, d), strict=False).select("image_id", "rank", "notes")


@query(f"{_REFINE} SELECT im.run_id, im.image_id, row_number() OVER (PARTITION BY im.run_id ORDER BY rank IS NULL, rank DESC, im.image_id) AS place FROM im LEFT JOIN st USING (image_id) WHERE passed")
def refined_ranking(spark, d):
    out = review.apply_refinements(*_refinements(spark, d), strict=False).withColumn("hitl_rating", F.lit(None).cast("int"))
    return review.refined_ranking(out).select("run_id", "image_id", "place")


@query(f"WITH {T.IMAGES}, {T.COMPOSITE}, {T.GATED} SELECT run_id, count(*) AS n, round(sum(identity), 6) AS identity FROM gated WHERE passed = false GROUP BY run_id")
def reject_records(spark, d):
    return review.reject_records(_gated(spark, d)).groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("identity"), 6).alias("identity"))


@query(f"WITH im AS (SELECT o_orderkey AS image_id, {_PASSED} AS passed FROM orders) SELECT image_id FROM im WHERE passed IS NOT NULL AND image_id NOT IN (SELECT user_id FROM events)")
def missing_images(spark, d):
    images, _ = _reviewed(spark, d)
    return review.missing_images(images, T.read(spark, d, "events").select(F.col("user_id").alias("image_id"))).select("image_id")


@query(f"WITH im AS (SELECT o_orderkey AS image_id, {_PASSED} AS passed FROM orders) SELECT image_id FROM im WHERE passed")
def passing_subset(spark, d):
    return review.passing(_reviewed(spark, d)[0]).select("image_id")


_ALPHA = """WITH r AS (SELECT l_orderkey AS unit, l_quantity AS x FROM lineitem), u AS (SELECT unit, count(*) AS m, sum(x) AS s, sum(x * x) AS q FROM r GROUP BY unit HAVING count(*) > 1),
t AS (SELECT sum(m)::DOUBLE AS n, count(*) AS k, sum(s) AS s, sum(q) AS q, sum(2 * (m * q - s * s) / (m - 1)) AS o FROM u)
SELECT round(1 - (o / n) / (2 * (n * q - s * s) / (n * (n - 1))), 9) AS alpha, n::BIGINT AS n_ratings, k AS n_units FROM t"""


@query(_ALPHA)
def alpha_interval(spark, d):
    ratings = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("rater"), F.col("l_quantity").alias("rating"))
    return _r(review.krippendorff_alpha(ratings), "alpha")


@query("""WITH r AS (SELECT doc_id AS unit, quality AS x FROM labels UNION ALL SELECT doc_id, toxic FROM labels), c AS (SELECT unit, x, count(*) AS c FROM r GROUP BY ALL), u AS (SELECT unit, sum(c) AS m, sum(c * c) AS cc FROM c GROUP BY unit HAVING sum(c) > 1),
v AS (SELECT sum(c * c) AS vv FROM (SELECT x, sum(c) AS c FROM c JOIN u USING (unit) GROUP BY x)), t AS (SELECT sum(m)::DOUBLE AS n, count(*) AS k, sum((m * m - cc) / (m - 1)) AS o FROM u)
SELECT round(1 - (o / n) / ((n * n - vv) / (n * (n - 1))), 9) AS alpha, n::BIGINT AS n_ratings, k AS n_units FROM t, v""")
def alpha_nominal(spark, d):
    labels = T.read(spark, d, "labels")
    both = labels.select(F.col("doc_id").alias("unit_id"), F.lit("quality").alias("rater"), F.col("quality").cast("double").alias("rating")).unionByName(labels.select(F.col("doc_id").alias("unit_id"), F.lit("toxic").alias("rater"), F.col("toxic").cast("double").alias("rating")))
    return _r(review.krippendorff_alpha(both, "nominal"), "alpha")


_RATED = """WITH r AS (SELECT l_orderkey AS unit, {} AS x FROM lineitem), u AS (SELECT unit, count(*) AS m FROM r GROUP BY unit HAVING count(*) > 1), c AS (SELECT unit, x, m, count(*) AS c FROM r JOIN u USING (unit) GROUP BY ALL),
t AS (SELECT x, sum(c) AS t, sum(sum(c)) OVER (ORDER BY x) - sum(c) / 2.0 AS mid FROM c GROUP BY x), n AS (SELECT sum(m)::DOUBLE AS n, count(*) AS k FROM u), """


@query(_RATED.format("l_extendedprice") + """s AS (SELECT unit, m, sum(c * (mid - n / 2)) AS s, sum(c * (mid - n / 2) ** 2) AS q FROM c JOIN t USING (x), n GROUP BY ALL),
o AS (SELECT sum(2 * (m * q - s * s) / (m - 1)) AS o FROM s), e AS (SELECT 2 * (any_value(n) * sum(t * (mid - n / 2) ** 2) - sum(t * (mid - n / 2)) ** 2) / (any_value(n) * (any_value(n) - 1)) AS e FROM t, n)
SELECT round(1 - (o / n) / e, 9) AS alpha, n::BIGINT AS n_ratings, k AS n_units FROM n, o, e""")
def alpha_ordinal(spark, d):
    """Prices as ratings: nearly as many values as ratings."""
    ratings = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("rater"), F.col("l_extendedprice").alias("rating"))
    return _r(review.krippendorff_alpha(ratings, "ordinal"), "alpha")


@query(_RATED.format("floor(l_extendedprice / 20)") + """o AS (SELECT sum(2 * a.c * b.c * ((a.x - b.x) / nullif(a.x + b.x, 0)) ** 2 / (a.m - 1)) AS o FROM c a JOIN c b ON a.unit = b.unit AND a.x < b.x),
e AS (SELECT sum(2 * a.t * b.t * ((a.x - b.x) / nullif(a.x + b.x, 0)) ** 2) AS e FROM t a JOIN t b ON a.x < b.x)
SELECT round(1 - (o / n) / (e / (n * (n - 1))), 9) AS alpha, n::BIGINT AS n_ratings, k AS n_units FROM n, o, e""")
def alpha_ratio(spark, d):
    """Prices in steps of 20 as ratings: some thousands of values."""
    ratings = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("rater"), F.floor(F.col("l_extendedprice") / 20).cast("double").alias("rating"))
    return _r(review.krippendorff_alpha(ratings, "ratio"), "alpha")


@query(f"WITH im AS (SELECT o_orderkey AS image_id, {_PASSED} AS passed FROM orders) SELECT image_id, CASE WHEN passed THEN 'passed' WHEN NOT passed THEN 'failed' ELSE 'needs_review' END AS tags FROM im")
def sample_tags(spark, d):
    return explore.sample_tags(_reviewed(spark, d)[0]).select("image_id", F.array_join("tags", ",").alias("tags"))


# -- similarity ------------------------------------------------------------------

_HASH = "h AS (SELECT label AS run_id, vec_id AS ordinal, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)"
_PAIRS = _HASH + ", p AS (SELECT x.run_id, x.ordinal AS u, y.ordinal AS v, list_sum(list_transform(list_zip(x.b, y.b), lambda z: abs(z[1] - z[2])))::INT AS distance FROM h x JOIN h y ON x.run_id = y.run_id AND x.ordinal < y.ordinal)"


@query(f"WITH {_PAIRS} SELECT run_id, u, v, distance FROM p WHERE distance <= 17")
def hamming_pairs(spark, d):
    return similarity.hamming_pairs(T.hashes(spark, d), 17)


_MONTH = "((year(o_orderdate) * 12 + month(o_orderdate)) % 64)::INT"
_MONTHS = f"months AS (SELECT c_mktsegment AS run_id, o_custkey AS ordinal, bit_or(CASE WHEN {_MONTH} = 63 THEN -9223372036854775808 ELSE 1::BIGINT << least(62, {_MONTH}) END) AS hash FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


@query(f"WITH {_MONTHS} SELECT x.run_id, x.ordinal AS u, y.ordinal AS v, bit_count(xor(x.hash, y.hash))::INT AS distance FROM months x JOIN months y ON x.run_id = y.run_id AND x.ordinal < y.ordinal AND bit_count(xor(x.hash, y.hash)) <= 5")
def hamming_months(spark, d):
    """Customers of a segment whose order months differ in five bits at most."""
    orders, customer = T.read(spark, d, "orders"), T.read(spark, d, "customer")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")) % 64
    held = orders.join(customer, orders.o_custkey == customer.c_custkey).select(F.col("c_mktsegment").alias("run_id"), F.col("o_custkey").alias("ordinal"), month.alias("month"))
    hashed = held.groupBy("run_id", "ordinal").agg(F.expr("bit_or(shiftleft(1L, month))").alias("hash"))
    return similarity.hamming_pairs(hashed, 5)


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT run_id, u, v FROM p WHERE distance <= 17 UNION ALL SELECT run_id, v, u FROM p WHERE distance <= 17),
r AS (SELECT run_id, ordinal, ordinal AS seen FROM h UNION SELECT r.run_id, r.ordinal, e.v FROM r JOIN e ON e.run_id = r.run_id AND e.u = r.seen),
m AS (SELECT run_id, ordinal, min(seen) AS label FROM r GROUP BY ALL) SELECT run_id, ordinal, (dense_rank() OVER (PARTITION BY run_id ORDER BY label) - 1)::INT AS duplicate_group FROM m""")
def dup_components(spark, d):
    return similarity.group_labels(T.hashes(spark, d), 17)


_LABELLED = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT run_id, u, v FROM p WHERE distance <= 17 UNION ALL SELECT run_id, v, u FROM p WHERE distance <= 17),
r AS (SELECT run_id, ordinal, ordinal AS seen FROM h UNION SELECT r.run_id, r.ordinal, e.v FROM r JOIN e ON e.run_id = r.run_id AND e.u = r.seen), m AS (SELECT run_id, ordinal, min(seen) AS label FROM r GROUP BY ALL),
g AS (SELECT run_id, label, max(CASE WHEN ordinal % 100 >= 70 THEN 2 WHEN ordinal % 100 <= 40 THEN 0 ELSE 1 END) AS best FROM m GROUP BY ALL)"""


@query(f"{_LABELLED} SELECT run_id, count(*) AS n_groups, count(*) FILTER (best = 2) AS n_passed, count(*) FILTER (best = 1) AS n_needs_hitl FROM g GROUP BY run_id")
def collapsed_pass_rate(spark, d):
    hashed = T.hashes(spark, d)
    none = F.lit(None).cast("double")
    rows = hashed.select("run_id", "ordinal", none.alias("identity"), none.alias("clip_score"), ((F.col("ordinal") % 100) / 100).alias("aesthetic"), none.alias("preference"), none.alias("safety"))
    grouped = rows.join(similarity.group_labels(hashed, 17), ["run_id", "ordinal"])
    return rollup.roll_up(rollup.gate(grouped)).select("run_id", "n_groups", "n_passed", "n_needs_hitl")


@query(f"WITH {_PAIRS} SELECT run_id, round(avg(distance) / 64.0, 9) AS diversity FROM p GROUP BY run_id")
def diversity(spark, d):
    return _r(similarity.diversity(T.hashes(spark, d)).select("run_id", "diversity"), "diversity")


_COSINE = """WITH refs AS (SELECT label, embedding FROM embeddings WHERE vec_id % 25 = 0), c AS (SELECT e.vec_id AS image_id, list_cosine_similarity(e.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings e LEFT JOIN refs r USING (label))
SELECT image_id, CASE WHEN count(s) > 0 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}(s))), 9) END AS identity FROM c GROUP BY image_id"""


def _identity(spark, d, how):
    e = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("subject"), "embedding")
    return _r(similarity.identity(e, e.where("image_id % 25 = 0").select("subject", "embedding"), how).select("image_id", "identity"), "identity")


@query(_COSINE.format("max"))
def identity_cosine(spark, d):
    return _identity(spark, d, "max")


@query(_COSINE.format("avg"))
def identity_cosine_mean(spark, d):
    return _identity(spark, d, "mean")


# -- moderation ------------------------------------------------------------------

_WORDS = {"violence": ("there", "that"), "hate": ("the",), "self_harm": ("with",)}
_TAILS = """t AS (SELECT category, any_value(o) AS category_order, bool_or(score >= 0.5) AS any_hit, count(*) FILTER (score >= 0.5) / count(*)::DOUBLE AS hit_rate, max(score) AS max_score, quantile_cont(score, 0.95) AS p95 FROM f GROUP BY category)"""
_CATS = "cats AS (SELECT unnest(['sexual', 'violence', 'hate', 'self_harm', 'weapons', 'illegal']) AS category, unnest([0, 1, 2, 3, 4, 5]) AS o)"
_DETECT = f"""WITH {_CATS}, it AS (SELECT o_orderkey AS item_id FROM orders), s AS (SELECT l_orderkey AS item_id, ['sexual', 'violence', 'hate', 'other'][(l_partkey % 4 + 1)::INT] AS category, max(l_quantity / 50) AS score FROM lineitem GROUP BY ALL),
f AS (SELECT it.item_id, cats.category, o, coalesce(score, 0.0) AS score FROM it CROSS JOIN cats LEFT JOIN s ON s.item_id = it.item_id AND s.category = cats.category), {_TAILS}"""


def _detected(spark, d):
    li = T.read(spark, d, "lineitem")
    names = F.array(*[F.lit(c) for c in ("sexual", "violence", "hate", "other")])
    return li.select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").cast("string").alias("detector"), F.element_at(names, (F.col("l_partkey") % 4 + 1).cast("int")).alias("category"), (F.col("l_quantity") / 50).alias("score"))


@query("SELECT l_orderkey AS item_id, ['sexual', 'violence', 'hate', 'other'][(l_partkey % 4 + 1)::INT] AS category, round(max(l_quantity / 50), 9) AS score FROM lineitem GROUP BY ALL")
def ensemble_max(spark, d):
    return _r(moderation.combine(_detected(spark, d)), "score")


@query(f"{_DETECT} SELECT category, category_order, any_hit, round(hit_rate, 9) AS hit_rate, round(max_score, 9) AS max_score, round(p95, 9) AS p95 FROM t")
def category_tails(spark, d):
    items = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return _r(moderation.tails(items, moderation.combine(_detected(spark, d))), "hit_rate", "max_score", "p95")


@query(f"{_DETECT} SELECT category, round(hit_rate, 9) AS hit_rate, max_score, row_number() OVER (ORDER BY max_score DESC, category_order) AS rank FROM t WHERE hit_rate > 0")
def flagged_order(spark, d):
    items = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"))
    return _r(moderation.flagged(moderation.tails(items, moderation.combine(_detected(spark, d)))), "hit_rate")


@query(f"""WITH {_CATS}, it AS (SELECT conv_id * 1000 + turn AS item_id, lower(text) AS x FROM conversations),
f AS (SELECT item_id, category, o, CASE WHEN (category = 'violence' AND regexp_matches(x, '\\b(there|that)\\b')) OR (category = 'hate' AND regexp_matches(x, '\\b(the)\\b')) OR (category = 'self_harm' AND regexp_matches(x, '\\b(with)\\b')) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM it CROSS JOIN cats), {_TAILS}
SELECT category, any_hit, round(hit_rate, 9) AS hit_rate, max_score, 'text' AS side, (SELECT count(*) FROM it) AS n_items FROM t""")
def text_moderation(spark, d):
    items = T.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text")
    return _r(moderation.moderate(items, moderation.keyword_scores(items, _WORDS), "text", ("keywords@1",)).select("category", "any_hit", "hit_rate", "max_score", "side", "n_items"), "hit_rate")


# -- grids -----------------------------------------------------------------------

_AXES = {"setting": ("park", "studio", "street"), "light": ("dawn", "noon"), "empty": ()}


@query("SELECT DISTINCT ON (text) trim(text) AS prompt, item_id AS pos FROM benchmark WHERE trim(text) <> '' ORDER BY text, item_id")
def dedup_first_seen(spark, d):
    b = T.read(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("prompt"))
    return grid.base_prompts(b).select("prompt", "pos")


@query("SELECT (a.i * 3 + b.i)::BIGINT AS combo_pos, a.x || ', ' || b.x AS combo FROM (SELECT unnest(['dawn', 'noon']) AS x, unnest([0, 1]) AS i) a, (SELECT unnest(['park', 'studio', 'street']) AS x, unnest([0, 1, 2]) AS i) b")
def token_combos(spark, d):
    return grid.token_combos(spark, _AXES)


def _grid(spark, d):
    b = T.read(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("prompt"))
    items = grid.prompt_items(grid.base_prompts(b), grid.token_combos(spark, _AXES))
    loras = T.read(spark, d, "region").select(F.col("r_regionkey").alias("lora_pos"), F.col("r_name").alias("lora"))
    weights = spark.range(3).select(F.col("id").alias("weight_pos"), (0.6 + F.col("id") * 0.2).alias("weight"))
    return grid.expand(items, loras, weights, "run")


_GRID = """WITH b AS (SELECT trim(text) AS t, min(item_id) AS pos FROM benchmark WHERE trim(text) <> '' GROUP BY 1), bi AS (SELECT t, row_number() OVER (ORDER BY pos) - 1 AS i FROM b),
c AS (SELECT a.i * 3 + b.i AS j, a.x || ', ' || b.x AS combo FROM (SELECT unnest(['dawn', 'noon']) AS x, unnest([0, 1]) AS i) a, (SELECT unnest(['park', 'studio', 'street']) AS x, unnest([0, 1, 2]) AS i) b),
g AS (SELECT printf('run-l%02d-w%02d-p%03d', r_regionkey::INT, w::INT, (i * 6 + j)::INT) AS run_id, r_name AS lora, t || ', ' || combo AS prompt FROM region, range(3) w(w), bi, c)"""


@query(f"{_GRID} SELECT run_id, lora, prompt FROM g")
def grid_expand(spark, d):
    return _grid(spark, d).select("run_id", "lora", "prompt")


@query(f"{_GRID} SELECT count(*) AS runs, count(*) * 4 AS images, count(*) * 4 * 6.0::DOUBLE / 3600 AS gpu_hours FROM g")
def grid_estimate(spark, d):
    built = _grid(spark, d).agg(F.count("*").alias("runs"))
    return built.select("runs", (F.col("runs") * 4).alias("images"), (F.col("runs") * 4 * 6.0 / 3600).alias("gpu_hours"))


@query("""WITH cells AS (SELECT r_regionkey * 25 + n_nationkey AS i, r_name AS base, n_name AS step, CASE WHEN n_nationkey % 2 = 0 THEN 12.0 ELSE 6.0 END::DOUBLE AS s FROM region, nation)
SELECT printf('exp-c%02d-', i::INT) || regexp_replace(regexp_replace(lower(base), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || regexp_replace(regexp_replace(lower(step), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS cell_id, base, step, 32::BIGINT AS n_images, s * 32 AS gpu_seconds FROM cells""")
def experiment_cells(spark, d):
    bases = T.read(spark, d, "region").select(F.col("r_regionkey").alias("base_pos"), F.col("r_name").alias("base"))
    steps = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("step_pos"), F.col("n_name").alias("step"), F.when(F.col("n_nationkey") % 2 == 0, 12.0).alias("seconds"))
    return grid.experiment_cells(bases, steps, 32)


@query("SELECT p_partkey AS id, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') AS slug FROM part")
def slug(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), text.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


_TAGS = "WITH t AS (SELECT event_id AS id, ['rating:' || (event_id % 9), 'x' || event_type, 'rating:' || event_type, 'reject:' || ['anatomy', 'nothing', 'overfit'][(event_id % 3 + 1)::INT], 'reject:anatomy'] AS tags FROM events)"


@query(f"""{_TAGS} SELECT id, CASE WHEN id % 9 BETWEEN 1 AND 5 THEN (id % 9)::INT END AS rating, CASE id % 3 WHEN 2 THEN 'overfit,anatomy' ELSE 'anatomy' END AS rejects FROM t""")
def tag_parse(spark, d):
    codes = F.array(F.lit("anatomy"), F.lit("nothing"), F.lit("overfit"))
    tags = F.array(
        F.concat(F.lit("rating:"), (F.col("event_id") % 9).cast("string")), F.concat(F.lit("x"), "event_type"), F.concat(F.lit("rating:"), "event_type"),
        F.concat(F.lit("reject:"), F.element_at(codes, (F.col("event_id") % 3 + 1).cast("int"))), F.lit("reject:anatomy"),
    )
    rows = T.read(spark, d, "events").select(F.col("event_id").alias("id"), tags.alias("tags"))
    return rows.select("id", text.rating_of(F.col("tags")).alias("rating"), F.array_join(text.rejects_of(F.col("tags")), ",").alias("rejects"))


# -- extension points and small operators -----------------------------------------


@query("SELECT l_orderkey AS item_id, CASE WHEN min(l_linenumber) < 5 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - max(CASE WHEN l_linenumber < 5 THEN l_tax * 15 END))), 9) END AS safety FROM lineitem GROUP BY 1")
def safety_ensemble(spark, d):
    scores = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("detector"), F.when(F.col("l_linenumber") < 5, F.col("l_tax") * 15).alias("unsafe"))
    return _r(scoring.ensemble_safety(scores), "safety")


@query("SELECT l_orderkey AS image_id, l_extendedprice AS face FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) = 1")
def largest_face(spark, d):
    at = F.col("l_linenumber")
    faces = T.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), at.alias("x1"), F.col("l_partkey").alias("y1"), (at + F.col("l_quantity")).alias("x2"), (F.col("l_partkey") + 1).alias("y2"), F.array("l_extendedprice").alias("embedding"))
    return scoring.largest_face(faces).select("image_id", F.col("embedding")[0].alias("face"))


@query("""WITH p AS (SELECT o_custkey % 100 AS run_id, o_orderkey AS ord, (o_custkey % 100) || '-' || CASE WHEN o_orderpriority = '1-URGENT' THEN ((o_orderkey - 1) % 7) || '-' || (o_orderkey - 1) ELSE (o_orderkey % 7)::VARCHAR END AS id FROM orders),
f AS (SELECT *, ord > min(ord) OVER (PARTITION BY run_id, id) AS taken FROM p), made AS (SELECT DISTINCT run_id, id || '-' || ord AS id, ord FROM f WHERE taken)
SELECT f.run_id, f.ord, CASE WHEN taken OR made.ord IS NOT NULL THEN f.id || '-' || f.ord ELSE f.id END AS image_id FROM f LEFT JOIN made ON made.run_id = f.run_id AND made.id = f.id AND made.ord < f.ord""")
def unique_ids(spark, d):
    """Urgent orders are given an id: what the order before them would be made, if it is of their run and its own id is taken."""
    run, before = F.col("o_custkey") % 100, F.col("o_orderkey") - 1
    given = F.when(F.col("o_orderpriority") == "1-URGENT", F.concat_ws("-", run.cast("string"), (before % 7).cast("string"), before.cast("string")))
    produced = T.read(spark, d, "orders").select(run.alias("run_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 7).alias("seed"), given.alias("image_id"))
    return scoring.unique_ids(produced).select("run_id", "ord", "image_id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 1 THEN p_name END AS decoded FROM part")
def decode_image(spark, d):
    plain = F.base64(F.col("p_name").cast("binary"))
    broken = F.when(F.col("p_partkey") % 5 == 0, F.concat(plain, F.lit("!"))).when(F.col("p_partkey") % 5 == 1, F.concat(plain, F.lit("\n")))
    sent = F.coalesce(broken, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), plain)).otherwise(plain))
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), scoring.decode_image(sent).cast("string").alias("decoded"))


def _experiment(spark, d):
    bases = T.read(spark, d, "region").select(F.col("r_regionkey").alias("base_pos"), F.col("r_name").alias("base"))
    steps = spark.createDataFrame([(0, "fast", None), (1, "high quality", 12.0)], "step_pos int, step string, seconds double")
    prompts = T.read(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("prompt"))
    items = grid.prompt_items(grid.base_prompts(prompts), grid.token_combos(spark, {}))
    loras = spark.createDataFrame([(0, "l0"), (1, "l1")], "lora_pos int, lora string")
    weights = spark.createDataFrame([(0, 0.8)], "weight_pos int, weight double")
    return grid.experiment_runs(grid.experiment_cells(bases, steps, 200), items, loras, weights, {"caption": "long"})


_EXPERIMENT = """WITH s AS (SELECT unnest(['fast', 'high quality']) AS step, unnest([0, 1]) AS sp), c AS (SELECT printf('exp-c%02d-', (r_regionkey * 2 + sp)::INT) || regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') || '-' || replace(step, ' ', '-') AS cell_id, r_name, step FROM region, s),
r AS (SELECT cell_id, r_name AS base_checkpoint, '{"caption":"long","step_config":"' || step || '"}' AS labels, printf('%s-l%02d-w00-p%03d', cell_id, l::INT, n_nationkey::INT) AS run_id, n_name AS prompt FROM c, range(2) l(l), nation)"""


@query(f"{_EXPERIMENT} SELECT run_id, base_checkpoint, labels, prompt FROM r")
def experiment_runs(spark, d):
    return _experiment(spark, d).select("run_id", "base_checkpoint", "labels", "prompt")


@query(f"{_EXPERIMENT} SELECT cell_id, count(*) * 4 AS n_images FROM r GROUP BY cell_id")
def cell_images(spark, d):
    return grid.images_per_cell(_experiment(spark, d), 4).select(F.explode("per_cell").alias("cell_id", "n_images"))


@query(f"""{_RUNS} SELECT run_id || ': ' || CASE WHEN pending THEN 'PENDING' WHEN run_passed THEN 'PASSED' ELSE 'FAILED' END || ' — pass rate ' || format('{{:.0f}}', pass_rate * 100) || '% (' || n_passed || '/' || n_groups || ' groups, ' || n_images || ' images, ' || n_needs_hitl || ' need review)' AS line FROM runs""")
def run_digests(spark, d):
    runs = rollup.verdicts(rollup.roll_up(_gated(spark, d)))
    return runs.select(scoring.digest_line(runs).alias("line"))


@query(f"""{_RUNS} SELECT run_id, '[lens] unsafe outputs [unsafe_rate ' || format('{{:.2f}}', unsafe_rate) || ' vs 0.60]: filter/re-caption training data to remove unsafe content' AS line FROM runs WHERE unsafe_rate > 0.6""")
def recommend_lines(spark, d):
    floors = acceptance.Floors(0.6, None, None, None, None, None, None)
    found = acceptance.recommend(evaluate(T.images(spark, d), CONFIG), floors).where("metric = 'unsafe_rate'")
    return found.select("run_id", scoring.recommendation_line(found).alias("line"))


@query("SELECT trim(text) AS prompt FROM benchmark WHERE trim(text) <> '' GROUP BY 1 ORDER BY min(item_id) LIMIT 5")
def prompt_preview(spark, d):
    b = T.read(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("prompt"))
    return grid.preview(grid.base_prompts(b)).select("prompt")


@query("SELECT o_orderkey AS item_id, o_totalprice / 600000 AS safety, 1 AS n_scorers FROM orders")
def score_registry(spark, d):
    """One scorer measures, another is not there: its metric stays null."""
    rows = T.read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), "o_totalprice")
    scorers = [scoring.Scorer("price", "safety", lambda: F.col("o_totalprice") / 600000), scoring.Scorer("gone", "identity", lambda: F.lit(1.0), probe=lambda: False)]
    return scoring.score(rows, scorers).where("identity IS NULL").select("item_id", "safety", F.size("scorers").alias("n_scorers"))


@query("SELECT o_custkey AS run_id, o_totalprice AS pass_rate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus DESC, o_orderkey DESC) = 1")
def stream_upsert(spark, d):
    """Orders arrive as files, those of one status after those of another; the last to arrive is a customer's current one."""
    from uuid import uuid4

    from .sources.shared import shared_folder
    from .streaming.upsert import current, follow

    root = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    rows = T.read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_totalprice").alias("pass_rate"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    # The states of orders. A customer's orders of one state are in one file, so their order of arrival is known.
    for status in "FOP":
        rows.where(F.col("status") == status).drop("status").repartition(2, "run_id").write.mode("append").parquet(f"{root}/inbox")
    follow(spark, f"{root}/inbox", "run_id long, pass_rate double, ord long", f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return current(spark, f"{root}/log")


@query("""SELECT user_id::VARCHAR AS run_id, max(event_id) AS seq, CASE arg_max(event_type, event_id) WHEN 'purchase' THEN 'scoring' WHEN 'error' THEN 'error' ELSE 'running' END AS status,
arg_max(floor(value)::BIGINT, event_id) FILTER (event_type = 'signup') AS total, max(floor(value)::BIGINT) FILTER (event_type = 'view') AS completed, count(DISTINCT props) FILTER (event_type = 'click') AS n_images,
CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(props, event_id) END AS message FROM events GROUP BY user_id""")
def progress_state(spark, d):
    """A user is a run and its events are frames, which arrive one type after another, those of images twice."""
    from uuid import uuid4

    from .sources.shared import shared_folder
    from .sources.snapshots import SnapshotStore
    from .streaming.progress import follow_progress

    root = f"{shared_folder(spark)}/progress-{uuid4().hex}"
    # The types of events, and what each stands for.
    kinds = {"click": "image", "error": "error", "purchase": "scoring", "signup": "start", "view": "progress"}
    kind, number = F.col("type"), F.floor("value").cast("long")
    events = T.read(spark, d, "events").withColumn("type", F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")])
    frames = events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), "ts", "type", F.when(kind == "start", number).alias("total"), F.when(kind == "progress", number).alias("completed"),
        F.when(kind == "image", F.col("props")).alias("image_id"), F.when(kind == "error", F.col("props")).alias("message"),
    )
    for k in ("image", "error", "scoring", "image", "start", "progress"):
        frames.where(kind == k).write.mode("append").parquet(f"{root}/inbox")
    store = SnapshotStore(spark, f"{root}/store")
    follow_progress(spark, f"{root}/inbox", store, f"{root}/checkpoint", lateness="1000 days", silence_ms=10**12).awaitTermination()
    return store.current().drop("last")


def _looks(spark, d):
    return T.read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("look"))


@query("""WITH f AS (SELECT o_custkey AS run_id, o_orderkey AS ordinal, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders)
SELECT run_id, ordinal, dense_rank() OVER (PARTITION BY run_id ORDER BY first) - 1 AS duplicate_group FROM f""")
def plugin_groups(spark, d):
    """A customer's orders are images that look alike if they have one priority; a user's function says so."""
    deduper = plugins.Deduper("looks", lambda rows: rows["look"].factorize()[0].tolist())
    return plugins.group_images(_looks(spark, d), deduper)


@query("SELECT o_custkey AS run_id, round(count(DISTINCT o_orderpriority) / count(*)::DOUBLE, 9) AS diversity FROM orders GROUP BY ALL")
def plugin_diversity(spark, d):
    scorer = plugins.DiversityScorer("looks", lambda rows: rows["look"].nunique() / len(rows))
    return _r(plugins.score_diversity(_looks(spark, d), scorer), "diversity")


@query(f"""{_RUNS}, refined AS (SELECT run_id, count(*) FILTER (safety > 0.6 AND aesthetic > 0.4) AS n_refined FROM images GROUP BY run_id)
SELECT run_id, run_passed, pending, round(pass_rate, 9) AS pass_rate, n_images, n_groups, n_needs_hitl, n_refined FROM runs JOIN refined USING (run_id)""")
def report_summary(spark, d):
    images = T.images(spark, d).withColumn("refinement", F.when((F.col("safety") > 0.6) & (F.col("aesthetic") > 0.4), F.struct(F.lit(1).alias("rank"))))
    return _r(scoring.report_summaries(rollup.verdicts(rollup.roll_up(_gated(spark, d))), images), "pass_rate")


@query(f"""WITH im AS (SELECT o_custkey AS run_id, o_orderkey AS ordinal, {_PASSED} AS passed, CASE WHEN o_orderpriority < '3' THEN left(o_orderpriority, 1)::INT END AS rating FROM orders)
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ordinal) + 1 AS line_no, '  [' || CASE WHEN passed THEN '+' WHEN NOT passed THEN '-' ELSE '?' END || '] ' || ordinal || ' (seed ' || (ordinal + 1) || ')' ||
 CASE WHEN rating IS NOT NULL THEN ' hitl=' || rating ELSE '' END || CASE WHEN passed = false THEN ' rejects=anatomy,other' ELSE '' END AS line FROM im
UNION ALL SELECT run_id, 0, run_id || ': PENDING — pass rate 50% (1/2 groups, ' || count(*) || ' images, 1 need review)' FROM im GROUP BY run_id UNION ALL SELECT DISTINCT run_id, 1, '  reason: made up' FROM im""")
def digest_lines(spark, d):
    """A customer is a run, its orders are images."""
    passed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    codes = F.array(*[F.struct(F.lit(c).alias("code")) for c in ("anatomy", "other")])
    rating = F.when(F.col("o_orderpriority") < "3", F.substring("o_orderpriority", 1, 1).cast("int"))
    images = T.read(spark, d, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") + 1).alias("seed"), passed.alias("passed"), rating.alias("hitl_rating"), F.when(~passed, codes).alias("reject_reasons"))
    runs = images.groupBy("run_id").agg(F.count("*").alias("n_images")).select("run_id", "n_images", F.lit(False).alias("run_passed"), F.lit(True).alias("pending"), F.lit(0.5).alias("pass_rate"), F.lit(1).alias("n_passed"), F.lit(2).alias("n_groups"), F.lit(1).alias("n_needs_hitl"), F.array(F.lit("made up")).alias("reasons"))
    return scoring.digest_lines(runs, images)


@query(f"""{_RUNS} SELECT run_id, 20 AS ord, 'grid' AS stage, 'images' AS metric, n_images::DOUBLE AS value, 3.0::DOUBLE AS threshold FROM runs WHERE n_images < 3
UNION ALL SELECT run_id, 21, 'refine', 'needs_review', n_needs_hitl, 1 FROM runs WHERE n_needs_hitl > 1 UNION ALL SELECT run_id, 22, 'lens', 'safety', round(mean_safety, 9), 0.5 FROM runs WHERE mean_clip_score IS NULL AND mean_safety < 0.5""")
def recommend_by_rows(spark, d):
    """Rules that the library does not have, given as rows."""
    rules = spark.createDataFrame(
        [
            (20, "grid", "images", "n_images", "below", 3.0, "n_images", None, "few images", "more seeds"), (21, "refine", "needs_review", "n_needs_hitl", "above", 1.0, "n_needs_hitl", None, "open", "review"),
            (22, "lens", "safety", "mean_safety", "below", 0.5, "mean_safety", "mean_clip_score", "unsafe", "filter"), (23, "lens", "nothing", "no_such_measure", "below", 1.0, "pass_rate", None, "never", "never"),
        ],
        acceptance.RULE,
    )
    return _r(acceptance.recommend_by(evaluate(T.images(spark, d), CONFIG), rules).drop("issue", "action"), "value")
