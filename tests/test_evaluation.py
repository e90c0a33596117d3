"""Behaviours of the evaluation operators on small hand-made cases."""

import itertools
import math
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from evalspark.functions import scores as S
from evalspark.functions import stats, text
from evalspark.operators import acceptance, crossrun, explore, grid, manifests, moderation, review, rollup, scoring, similarity
from evalspark.sources import archive, files
from evalspark.streaming import upsert

IMAGE = "run_id string, image_id string, identity double, clip_score double, aesthetic double, preference double, safety double, duplicate_group int"


def images(spark, rows):
    """(run, image, aesthetic, group) with other metrics not measured, or full rows."""
    full = [r if len(r) == 8 else (r[0], r[1], None, None, r[2], None, None, r[3]) for r in rows]
    return spark.createDataFrame(full, IMAGE)


def test_quantile():
    assert abs(stats.normal_ppf(0.5)) < 1e-12 and abs(stats.normal_ppf(0.975) - 1.959964) < 1e-6 and abs(stats.normal_ppf(0.95) - 1.644854) < 1e-6
    assert abs(stats.normal_ppf(0.001) + stats.normal_ppf(0.999)) < 1e-12 and abs(stats.normal_ppf(0.001) + 3.090232) < 1e-5
    for p in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            stats.normal_ppf(p)


WILSON = [(0, 0, 0.0, 1.0), (3, 4, 0.300642, 0.954413), (300, 400, 0.705323, 0.789921), (8, 10, 0.490162, 0.943318), (10, 10, 0.722467, 1.0)]


def test_wilson(spark):
    table = spark.createDataFrame([w[:2] for w in WILSON], "k long, n long")
    stats.register_sql(spark)
    low, high = stats.wilson(F.col("k"), F.col("n"))
    for r, (k, n, lo, hi) in zip(table.select("k", "n", low.alias("lo"), high.alias("hi"), F.expr("wilson_low(k, n) AS a"), F.expr("wilson_high(k, n) AS b")).collect(), WILSON, strict=True):
        assert r.lo == pytest.approx(lo, abs=1e-6) and r.hi == pytest.approx(hi, abs=1e-6)
        assert (r.a, r.b) == (pytest.approx(r.lo, abs=1e-12), pytest.approx(r.hi, abs=1e-12)) and stats.wilson_interval(k, n) == (pytest.approx(r.lo), pytest.approx(r.hi))
    assert stats.wilson_interval(10, 10)[1] == 1.0
    with pytest.raises(ValueError):
        stats.wilson_interval(11, 10)
    with pytest.raises(Exception, match="successes"):
        spark.createDataFrame([(11, 10)], "k long, n long").select(low).collect()


def test_gate(spark):
    nan = float("nan")
    rows = [
        ("r", "mean", 0.8, 0.6, None, None, None, 0), ("r", "nothing", None, None, None, None, None, 0), ("r", "high", None, None, 0.9, None, None, 0), ("r", "low", None, None, 0.2, None, None, 0),
        ("r", "middle", None, None, 0.55, None, None, 0), ("r", "hard", 0.3, None, 0.95, None, None, 0), ("r", "nan", nan, None, None, None, None, 0), ("r", "edge", None, None, 0.7, None, None, 0), ("r", "edge2", None, None, 0.4, None, None, 0),
    ]
    got = {r.image_id: r for r in rollup.gate(images(spark, rows), S.GateConfig(hard_gates={"identity": 0.5})).collect()}
    assert got["mean"].composite == pytest.approx(0.7) and got["nothing"].composite is None
    want = {"nothing": None, "high": True, "low": False, "middle": None, "hard": False, "nan": None, "edge": True, "edge2": False}
    assert {k: got[k].passed for k in want} == want
    assert got["hard"].reject_codes == ["identity_mismatch"] and got["low"].reject_codes == ["low_quality"] and got["high"].reject_codes == []
    with pytest.raises(ValueError):
        S.GateConfig(auto_pass=0.3, auto_fail=0.4)


def test_normalisation(spark):
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame([(-1.0,), (0.25,), (7.0,), (nan,), (inf,), (None,)], "x double")
    got = table.select(S.clamp01(F.col("x")).alias("c"), S.detector_score(F.col("x")).alias("d"), S.linear_normalize(F.col("x"), 0.25, 0.25).alias("s")).collect()
    assert [r.c for r in got[:3]] == [0.0, 0.25, 1.0] and math.isnan(got[3].c) and got[4].c == inf
    assert [r.d for r in got] == [0.0, 0.25, 1.0, 1.0, 1.0, None] and got[5].c is None and got[5].s is None and [r.s for r in got[:3]] == [0.0, 1.0, 1.0]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(6.5,)], "safety double").select(S.checked("safety")).collect()


def test_runs(spark):
    rows = [("groups", f"g{i}", a, g) for i, (a, g) in enumerate([(0.9, 0), (0.9, 0), (0.9, 0), (0.9, 0), (0.1, 1)])]
    rows += [("any", "x", 0.9, 0), ("any", "y", 0.1, 0), ("open", "x", None, 0), ("open", "y", 0.1, 0)]
    rows += [("three", f"t{i}", a, None) for i, a in enumerate([0.9, 0.9, 0.9, 0.1])]
    rows += [("pending", f"p{i}", a, None) for i, a in enumerate([0.9, 0.9, 0.55, 0.55])] + [("failed", f"f{i}", a, None) for i, a in enumerate([0.55, 0.1, 0.1, 0.1])]
    got = {r.run_id: r for r in rollup.verdicts(rollup.roll_up(rollup.gate(images(spark, rows)))).collect()}
    assert (got["groups"].n_images, got["groups"].n_groups, got["groups"].n_passed, got["groups"].pass_rate) == (5, 2, 1, 0.5)
    assert (got["any"].n_groups, got["any"].n_passed) == (1, 1) and (got["open"].n_groups, got["open"].n_needs_hitl) == (1, 1)
    assert got["three"].run_passed and not got["three"].pending
    assert (got["pending"].run_passed, got["pending"].pending) == (False, True) and (got["failed"].run_passed, got["failed"].pending) == (False, False)
    assert got["three"].mean_aesthetic == pytest.approx(0.7) and got["three"].mean_safety is None


def test_means_do_not_depend_on_the_order_of_rows(spark):
    """Plain sums of .875, .875 and twice just under .125 are 2 or just under, by order; a rule at a mean of 0.5 must not tell."""
    taxes = [p for values in ((0.01, 0.01, 0.07, 0.07), (0.0, 0.02, 0.07, 0.07)) for p in sorted(set(itertools.permutations(values)))]
    rows = [(f"{i}-{group}", str(j), None, None, None, None, 1 - t * 12.5, j if group == "apart" else 0) for i, p in enumerate(taxes) for group in ("one", "apart") for j, t in enumerate(p)]
    runs = rollup.roll_up(rollup.gate(images(spark, rows))).cache()
    assert {r.mean_safety for r in runs.collect()} == {math.fsum(1 - t * 12.5 for t in taxes[0]) / 4} and runs.count() == 36
    rule = spark.createDataFrame([(1, "lens", "safety", "mean_safety", "below", 0.5, "mean_safety", None, "i", "a")], acceptance.RULE)
    assert acceptance.recommend_by(runs, rule).count() == 36
    nan, inf = float("nan"), float("inf")
    odd = [(k, str(i), None, None, None, None, x, None) for k, xs in (("nan", [0.1, nan]), ("inf", [0.1, inf]), ("big", [1e300, 1e300]), ("tiny", [5e-10, 1e-9]), ("none", [None])) for i, x in enumerate(xs)]
    got = {r.run_id: r.mean_safety for r in rollup.roll_up(rollup.gate(images(spark, odd))).collect()}
    assert math.isnan(got["nan"]) and got["inf"] == inf and got["big"] == 1e300 and got["tiny"] == pytest.approx(7.5e-10, abs=1e-17) and got["none"] is None


def test_tails_and_unsafe_rate(spark):
    rows = [("a", str(i), None, None, None, None, s, None) for i, s in enumerate([0.95, 0.98, 0.99, 0.1])] + [("b", "0", None, None, None, None, None, None)]
    table = images(spark, rows)
    got = {r.run_id: r for r in rollup.safety_tail(table).collect()}
    assert (got["a"].any_hit, got["a"].hit_rate, got["a"].safety_min) == (1.0, 0.25, 0.1)
    assert (got["b"].any_hit, got["b"].hit_rate, got["b"].safety_min, got["b"].safety_p05) == (0.0, 0.0, 0.0, 0.0)
    assert {r.run_id: r.unsafe_rate for r in acceptance.unsafe_rate(rollup.gate(table)).collect()} == {"a": 0.25, "b": 0.0}


def test_acceptance_and_recommendations(spark):
    nan = float("nan")
    runs = spark.createDataFrame(
        [("lucky", 3, 3, 3, 1.0, None, None, None, None, None, 0.0, None, False), ("odd", 4, 4, 1, 0.25, nan, 0.5, 0.9, None, 0.9, 0.1, 0.1, True)],
        "run_id string, n_images long, n_groups long, n_passed long, pass_rate double, mean_identity double, mean_clip_score double, mean_aesthetic double, mean_preference double, mean_safety double, unsafe_rate double, diversity double, pending boolean",
    )
    checks = acceptance.acceptance(runs, acceptance.Thresholds(0.75, 0.75, 0.5, 0.0)).where("run_id = 'lucky'").orderBy("ord").collect()
    assert [(c.name, c.passed) for c in checks] == [("pass_rate", True), ("pass_rate_ci_lower", False), ("identity_mean", False), ("unsafe_rate", True)]
    none = acceptance.acceptance(runs, acceptance.Thresholds(None)).collect()
    assert {c.name for c in none} == {"no_checks"} and not any(r.accepted for r in acceptance.accepted(acceptance.acceptance(runs, acceptance.Thresholds(None))).collect())
    fired = acceptance.recommend(runs).orderBy("ord").collect()
    assert [(r.run_id, r.stage, r.metric) for r in fired] == [("odd", "lens", "unsafe_rate"), ("odd", "forge", "identity"), ("odd", "grid", "diversity"), ("odd", "refine", "pass_rate")]


def test_slices_and_appends(spark):
    store = spark.createDataFrame(
        [("r1", "A", 5, 5, '{"tool":"x"}'), ("r2", "A", 5, 3, "{}"), ("r3", "B", 3, 3, None), ("r4", "C", 400, 380, '{"tool":"x"}'), ("r5", None, 2, 0, None)], "run_id string, base_checkpoint string, n_groups long, n_passed long, labels string"
    )
    got = {r.value: r for r in crossrun.slice_pass_rate(store, "base_checkpoint").collect()}
    assert (got["A"].n_runs, got["A"].n_groups, got["A"].n_passed) == (2, 10, 8) and got["A"].ci_low == pytest.approx(0.490162, abs=1e-6)
    assert got["C"].place == 1 and got["C"].ci_low == pytest.approx(0.924036, abs=1e-6) and got["B"].ci_low == pytest.approx(0.438503, abs=1e-6) and None in got
    assert {r.value: r.n_runs for r in crossrun.slice_pass_rate(store, "label:tool").collect()} == {"x": 2, None: 3}
    assert [r.value for r in crossrun.clear_winner(crossrun.slice_pass_rate(store, "base_checkpoint")).collect()] == []
    for bad in ("n_groups", "label:", "label:a b", "nothing"):
        with pytest.raises(ValueError):
            crossrun.check_dimension(bad)
    with pytest.raises(ValueError, match="older"):
        crossrun.slice_pass_rate(store.drop("labels"), "label:tool")
    again = crossrun.append(store, spark.createDataFrame([("r1", "A", 4, 4)], "run_id string, base_checkpoint string, n_groups long, n_passed long"), 1)
    assert again.count() == 5 and again.where("run_id = 'r1'").first().n_groups == 4


def test_run_stats(spark):
    manifests = spark.createDataFrame(
        [("one", "t", ("base", "s"), [("subj", "h", 0.80004)], "p", None, None, None), ("two", "t", ("base", "s"), [("style", "h", 1.0), ("subj", "h", 1.0)], "p", None, None, None), ("three", None, ("base", "s"), [], "p", None, None, None)],
        "run_id string, training_run_id string, base_checkpoint struct<name:string,sha256:string>, loras array<struct<name:string,sha256:string,weight:double>>, prompt string, created_at string, step_config string, labels string",
    )
    table = images(spark, [(r, "x", 0.9, None) for r in ("one", "two", "three")])
    got = {r.run_id: r for r in crossrun.run_stats(manifests, rollup.roll_up(rollup.gate(table)), rollup.safety_tail(table)).collect()}
    assert (got["one"].lora, got["one"].lora_weight) == ("subj", 0.8) and (got["two"].lora, got["two"].lora_weight) == ("style+subj", None) and got["three"].lora is None
    assert got["one"].safety_min is None


REVIEW = "run_id string, image_id string, batch long, ord long, rater string, hitl_rating int, reject_codes array<string>"


def test_reviews_fold_in_order(spark):
    table = spark.createDataFrame([("r", "a", True), ("r", "b", None), ("r", "c", None)], "run_id string, image_id string, passed boolean")
    log = [
        ("r", "a", 1, 0, "ann", 5, ["anatomy"]), ("r", "a", 2, 0, None, None, []), ("r", "b", 1, 0, "ann", 1, []), ("r", "b", 1, 1, "bob", 4, []), ("r", "zzz", 1, 0, "ann", 5, []),
    ]
    got = {r.image_id: r for r in review.apply_reviews(table, spark.createDataFrame(log, REVIEW)).collect()}
    assert (got["a"].passed, got["a"].hitl_rating, got["a"].hitl_rater) == (False, None, "ann")
    assert (got["b"].passed, got["b"].hitl_rating, got["b"].hitl_rater) == (True, 4, "bob") and got["c"].passed is None
    with pytest.raises(ValueError):
        review.apply_reviews(table, spark.createDataFrame([("r", "a", 1, 0, None, 6, [])], REVIEW))


def test_refinements(spark):
    table = spark.createDataFrame([("r", i, i != "x", s) for i, s in (("a", 3), ("b", 5), ("c", 4), ("x", 5))], "run_id string, image_id string, passed boolean, hitl_rating int")
    schema = "run_id string, image_id string, batch long, ord long, rater string, rank int, notes string"
    log = spark.createDataFrame([("r", "a", 1, 0, "ann", 5, "fine"), ("r", "c", 1, 0, "ann", 2, None), ("r", "b", 1, 0, "ann", 4, "n"), ("r", "b", 2, 0, "ann", None, None), ("r", "a", 2, 0, None, 4, None)], schema)
    out = review.apply_refinements(table, log)
    got = {r.image_id: (r["rank"], r.notes, r.refined_by) for r in out.collect()}
    assert got == {"a": (4, "fine", "ann"), "b": (None, None, None), "c": (2, None, "ann"), "x": (None, None, None)}
    assert [r.image_id for r in review.refined_ranking(out).orderBy("place").collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError, match="passing"):
        review.apply_refinements(table, spark.createDataFrame([("r", "x", 1, 0, None, 3, None)], schema))


def test_archives(spark):
    table = spark.createDataFrame([("r", "a", False, "/p", 1), ("r", "b", True, "/p", 2), ("r", "c", None, "/p", 3)], "run_id string, image_id string, passed boolean, path string, seed int")
    assert review.reject_records(table).columns == ["run_id", "seed"] and review.reject_records(table).count() == 1
    assert [r.image_id for r in review.missing_images(table, spark.createDataFrame([("b",)], "image_id string")).collect()] == ["a"]


def test_alpha(spark):
    units = [(u, r, float(x)) for u, pair in enumerate([(1, 2), (3, 3), (4, 5), (2, 1)]) for r, x in zip("ab", pair, strict=True)]
    schema = "unit_id int, rater string, rating double"
    table = spark.createDataFrame(units, schema)
    assert review.krippendorff_alpha(table).first().alpha == pytest.approx(0.8108108108108109) and review.krippendorff_alpha(table, "nominal").first().alpha == pytest.approx(0.16)
    assert review.krippendorff_alpha(table, "ratio").first().alpha == pytest.approx(0.5875537, abs=1e-6)
    assert 0.7 < review.krippendorff_alpha(table, "ordinal").first().alpha < 0.95
    same = spark.createDataFrame([(u, r, float(u)) for u in range(3) for r in "ab"], schema)
    assert review.krippendorff_alpha(same).first().alpha == 1.0
    assert math.isnan(review.krippendorff_alpha(table.where("rater = 'a'")).first().alpha)


def test_moderation(spark):
    schema = "item_id string, detector string, category string, score double"
    scores = spark.createDataFrame([("i1", "a", "violence", 0.2), ("i1", "a", "hate", 0.9), ("i1", "b", "violence", 0.8), ("i2", "a", "violence", float("nan")), ("i3", "a", "violence", 0.1)], schema)
    got = {(r.item_id, r.category): r.score for r in moderation.combine(scores).collect()}
    assert got == {("i1", "violence"): 0.8, ("i1", "hate"): 0.9, ("i2", "violence"): 1.0, ("i3", "violence"): 0.1}
    items = spark.createDataFrame([("i1",), ("i2",), ("i3",)], "item_id string")
    tail = {r.category: r for r in moderation.tails(items, moderation.combine(scores)).collect()}
    assert len(tail) == 6 and tail["violence"].hit_rate == pytest.approx(2 / 3) and tail["self_harm"].max_score == 0.0
    assert [r.category for r in moderation.flagged(moderation.tails(items, moderation.combine(scores))).orderBy("rank").collect()] == ["violence", "hate"]
    with pytest.raises(ValueError):
        moderation.moderate(items, scores, "text", ())
    codes = moderation.hazard_scores(spark.createDataFrame([("i", "S3", 0.4), ("i", "S12", 0.6), ("i", "S99", 1.0)], "item_id string, code string, confidence double")).collect()
    assert [(r.category, r.score) for r in codes] == [("sexual", 0.6)]


def test_hash_groups_and_diversity(spark):
    import random

    rng = random.Random(4)
    hashes = []
    for run in ("a", "b"):
        base = [rng.getrandbits(64) for _ in range(12)]
        for i in range(60):
            h = rng.choice(base)
            for b in rng.sample(range(64), rng.randint(0, 4)):
                h ^= 1 << b
            hashes.append((run, i, h - (1 << 64) if h >> 63 else h))
    table = spark.createDataFrame(hashes, "run_id string, ordinal long, hash long")
    want, label = set(), {}
    by = {r: [(o, h % (1 << 64)) for x, o, h in hashes if x == r] for r in ("a", "b")}
    for run, rows in by.items():
        parent = {o: o for o, _ in rows}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (o, h) in enumerate(rows):
            for p, g in rows[i + 1 :]:
                if (h ^ g).bit_count() <= 5:
                    want.add((run, o, p, (h ^ g).bit_count()))
                    a, b = sorted((root(o), root(p)))
                    parent[b] = a
        seen = []
        for o, _ in rows:
            seen += [root(o)] if root(o) not in seen else []
            label[run, o] = seen.index(root(o))
    assert {tuple(r) for r in similarity.hamming_pairs(table).collect()} == want
    assert {(r.run_id, r.ordinal): r.duplicate_group for r in similarity.group_labels(table).collect()} == label
    spread = {r.run_id: r.diversity for r in similarity.diversity(table).collect()}
    rows = by["a"]
    assert spread["a"] == pytest.approx(sum((h ^ g).bit_count() for i, (_, h) in enumerate(rows) for _, g in rows[i + 1 :]) / (60 * 59 / 2) / 64)


@pytest.mark.parametrize("threshold", [0, 5, 8, 11, 13, 16, 17, 20, 24, 31, 63, 64])
def test_hamming_pairs_at_the_threshold(spark, threshold):
    """Pairs that differ in as many bits as allowed, spread so that few bands stay equal; one bit more is too far."""
    import random

    rng = random.Random(threshold)
    masks = [sum(1 << (i * 64 // threshold) for i in range(threshold))] if threshold else [0]
    masks += [0x1111111111111111] if threshold in (16, 17) else []
    for m in [*masks, *[sum(1 << b for b in rng.sample(range(64), threshold)) for _ in range(20)]]:
        masks += [m, m ^ 1 << (m ^ (1 << 64) - 1).bit_length() - 1] if m != (1 << 64) - 1 else [m]
    rows, want = [], set()
    for i, m in enumerate(masks):
        base = rng.getrandbits(64)
        rows += [(f"r{i}", j, h - (1 << 64) if h >> 63 else h) for j, h in enumerate((base, base ^ m))]
        if m.bit_count() <= threshold:
            want.add((f"r{i}", 0, 1, m.bit_count()))
    table = spark.createDataFrame(rows, "run_id string, ordinal long, hash long")
    assert {tuple(r) for r in similarity.hamming_pairs(table, threshold).collect()} == want
    if threshold == 17:
        labels = similarity.group_labels(table, threshold).collect()
        assert {r.run_id for r in labels if r.duplicate_group == 1} == {f"r{i}" for i, m in enumerate(masks) if m.bit_count() > threshold}


def test_identity(spark):
    e = spark.createDataFrame([("par", "s", [2.0, 0.0]), ("neg", "s", [-1.0, 0.0]), ("none", "s", None), ("nan", "s", [float("nan"), 0.0]), ("other", "t", [1.0, 0.0])], "image_id string, subject string, embedding array<double>")
    refs = spark.createDataFrame([("s", [1.0, 0.0]), ("s", [0.0, 1.0])], "subject string, embedding array<double>")
    got = {r.image_id: r.identity for r in similarity.identity(e, refs).collect()}
    assert (got["par"], got["neg"], got["none"], got["other"]) == (1.0, 0.0, 0.0, None) and math.isnan(got["nan"])


@pytest.mark.parametrize("how", ["max", "mean"])
def test_identity_of_many_references(spark, monkeypatch, how):
    """One subject with most references, in clusters; blocks are small, so that bounds leave some out."""
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "IMAGES", 32)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    vectors = {"hot": centres[np.arange(400) % 9] + 0.05 * rng.normal(size=(400, 12)), "small": rng.normal(size=(3, 12)), "zero": np.zeros((1, 12))}
    faces = [(f"{s}{i}", s, (centres[i % 9] + 0.05 * rng.normal(size=12)).tolist()) for s in ("hot", "small", "zero", "none") for i in range(60)] + [("gone", "hot", None), ("flat", "hot", [0.0] * 12)]
    images = spark.createDataFrame(faces, "image_id string, subject string, embedding array<double>")
    refs = spark.createDataFrame([(s, v.tolist()) for s, vs in vectors.items() for v in vs] + [("hot", None)], "subject string, embedding array<double>")
    got = {r.image_id: r.identity for r in similarity.identity(images, refs, how).collect()}
    for name, subject, face in faces:
        if subject == "none":
            assert got[name] is None
            continue
        x, v = np.array(face or [0.0] * 12), vectors[subject]
        sizes = np.linalg.norm(v, axis=1) * np.linalg.norm(x)
        cosines = np.divide(v @ x, sizes, out=np.zeros(len(v)), where=sizes > 0)
        assert got[name] == pytest.approx(min(1.0, max(0.0, cosines.max() if how == "max" else cosines.mean())), abs=1e-12)
    with pytest.raises(Exception, match="length"):
        similarity.identity(images, spark.createDataFrame([("hot", [1.0])], refs.schema), how).collect()


def test_texts(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert one(text.strip(F.lit("  \t a b\n "))) == "a b" and one(text.slug(F.lit("My Model.v2.safetensors"))) == "my-model-v2" and one(text.slug(F.lit("!!"))) == "x"
    assert one(text.category_slug(F.lit(" Self-Harm "))) == "self_harm" and one(text.category_slug(F.lit("self  harm"))) == "self_harm"
    assert one(text.run_id(F.lit("p"), F.lit(1), F.lit(123), F.lit(4))) == "p-l01-w123-p004"
    tags = F.array(*[F.lit(t) for t in ("rating:2", "rating:9", "rating:4.7", "rating: 5 ", "reject:anatomy", "reject:bogus", "reject:anatomy")])
    assert one(text.rating_of(tags)) == 5 and one(text.rejects_of(tags)) == ["anatomy"]
    assert [one(text.is_file_name(F.lit(n))) for n in ("a", " ", "..", "a/b", "a\\b")] == [True, False, False, False, False]


def test_grids(spark):
    prompts = spark.createDataFrame([(0, " x "), (1, ""), (2, "y"), (3, "x"), (4, "z")], "pos long, prompt string")
    assert [r.prompt for r in grid.base_prompts(prompts, 2).orderBy("item").collect()] == ["x", "y"]
    axes = {"setting": ["park", "studio"], "hour": ["dawn", "noon", "dusk"], "none": []}
    combos = [r.combo for r in grid.token_combos(spark, axes).orderBy("combo_pos").collect()]
    assert combos == [f"{h}, {s}" for h in axes["hour"] for s in axes["setting"]]
    capped = [r.combo for r in grid.token_combos(spark, axes, cap=3, seed=1).orderBy("combo_pos").collect()]
    assert len(capped) == 3 and capped == sorted(capped) and set(capped) <= set(combos) and grid.combo_count(axes, 3) == 3
    flex = spark.createDataFrame([(0, " wild ")], "pos long, prompt string")
    items = grid.prompt_items(grid.base_prompts(prompts, 1), grid.token_combos(spark, {"setting": ["park", "studio"]}), flex)
    assert [(r.item, r.kind, r.prompt) for r in items.orderBy("item").collect()] == [(0, "p", "x, park"), (1, "p", "x, studio"), (2, "f", "wild")]
    runs = grid.expand(items, spark.createDataFrame([(0, "a"), (1, "b")], "lora_pos long, lora string"), spark.createDataFrame([(0, 0.5), (1, 1.0)], "weight_pos long, weight double"), "g")
    assert runs.count() == 12 == grid.estimate(2, 2, 3, 4).runs and grid.estimate(2, 2, 3, 4).images == 48 and "g-l01-w01-f002" in {r.run_id for r in runs.collect()}
    grid.within_budget(2.0, 2.0)
    with pytest.raises(ValueError):
        grid.within_budget(2.01, 2.0)
    assert grid.search({"a": [1, 2, 3], "b": [0, 10]}, lambda p: p["a"] + p["b"], 50)["best_params"] == {"a": 3, "b": 10}


def png(width, height, *chunks):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + b"".join(chunk(*c) for c in chunks) + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    run = tmp_path / "runs" / "r-1"
    run.mkdir(parents=True)
    (run / "manifest.json").write_text('{"run_id": "r-1", "proof_version": "1.2", "seeds": [18446744073709551615], "sampling": {"width": 64, "height": 32}}')
    (run / "r-1-7.png").write_bytes(png(1024, 768, (b"tEXt", b"k\0v"), (b"zTXt", b"z\0\0" + zlib.compress(b"packed")), (b"zTXt", b"bad\0\0nope"), (b"tEXt", b"noseparator"), (b"iTXt", b"i\0\0\0en\0\0caf\xc3\xa9")))
    (run / "r-1-18446744073709551615-2.jpg").write_bytes(b"x")
    (run / "r-10-7.png").write_bytes(b"x")
    found = {r.image_id: r for r in files.discover_images(spark, str(tmp_path / "runs")).collect()}
    assert set(found) == {"r-1-7", "r-1-18446744073709551615-2"} and (found["r-1-7"].width, found["r-1-7"].height) == (1024, 768)
    assert int(found["r-1-18446744073709551615-2"].seed) == 2**64 - 1 and found["r-1-18446744073709551615-2"].width == 64
    texts = files.files(spark, str(run)).where("name = 'r-1-7.png'").select(files.png_text("content").alias("t")).first().t
    assert texts == {"k": "v", "z": "packed", "i": "café"}
    (run / "manifest.json").write_text('{"run_id": "r-1", "proof_version": "2.0"}')
    with pytest.raises(Exception, match="not supported"):
        files.manifests(spark, str(tmp_path / "runs")).collect()


def test_exports(spark, tmp_path):
    lines, texts = tmp_path / "lines", tmp_path / "texts"
    lines.mkdir(), texts.mkdir()
    (lines / "a.jsonl").write_text('{"name": "n", "final_caption": " one "}\nbroken\n{"caption_variants": {"zeroshot": "two"}, "final_caption": "x"}\n')
    (lines / "b.txt").write_text("never")
    (texts / "b.txt").write_text(" second ")
    (texts / "a.txt").write_text("first")
    (texts / "_c.txt").write_text("zeroth")
    (texts / ".d.txt").write_text("hidden")
    (texts / "texts").mkdir()
    (texts / "texts" / "z.txt").write_text("last")
    beside = tmp_path / "beside"
    beside.mkdir()
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "one.two.txt").write_text(" by the image ")
    (beside / "manifest.jsonl").write_text('{"abs_path": "%s/images/one.two.png"}\nbroken\n{"abs_path": "%s/images/gone.png"}\n{"abs_path": 3}\n' % (tmp_path, tmp_path))
    assert [r.prompt for r in files.export_prompts(spark, str(beside)).collect()] == ["by the image"]
    (texts / "c.txt").write_bytes(b"\xff\xfe")
    (texts / "blank.txt").write_text("  ")
    assert [r.prompt for r in files.export_prompts(spark, str(lines)).orderBy("pos").collect()] == ["one", "two"]
    assert [r.prompt for r in files.export_prompts(spark, str(texts)).orderBy("pos").collect()] == ["zeroth", "first", "second", "last"]
    assert {r.rel for r in files.files(spark, str(texts)).where("name = 'z.txt'").collect()} == {"texts/z.txt"}


def test_report_store(spark, tmp_path):
    schema, folder = "run_id string, n int", str(tmp_path / "reports")
    rows = spark.createDataFrame([("run-1", 1), ("run-1-2", 2), ("_a", 3), (".b", 4)], schema)
    assert files.save_reports(rows, folder).count() == 4
    (tmp_path / "reports" / "foreign.json").write_text("no report")
    assert [r["name"] for r in files.reports(spark, folder, schema).collect()] == [".b.json", "_a.json", "run-1-2.json", "run-1.json"]
    files.save_reports(spark.createDataFrame([("run-1", 9)], schema), folder).count()
    assert files.report(spark, folder, "run-1", schema).first().n == 9 and len(list((tmp_path / "reports").iterdir())) == 5
    with pytest.raises(FileNotFoundError):
        files.report(spark, folder, "gone", schema)
    for bad in ("../x", "", ".", "a/b", "a\\b"):
        with pytest.raises(ValueError, match="not a run"):
            files.report(spark, folder, bad, schema)
        with pytest.raises(Exception, match="not a run"):
            files.save_reports(spark.createDataFrame([(bad, 1)], schema), folder).count()
    assert files.stored(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "run_id string, pass_rate double, ord long"
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("inbox", "log", "checkpoint"))
    spark.createDataFrame([("r1", 0.1, 0), ("r2", 0.2, 0)], schema).coalesce(1).write.parquet(inbox)
    upsert.follow(spark, inbox, schema, log, checkpoint).awaitTermination()
    spark.createDataFrame([("r1", 0.9, 0)], schema).coalesce(1).write.mode("append").parquet(inbox)
    upsert.follow(spark, inbox, schema, log, checkpoint).awaitTermination()
    assert {r.run_id: r.pass_rate for r in upsert.current(spark, log).collect()} == {"r1": 0.9, "r2": 0.2}


def test_viewer_round_trip(spark):
    table = spark.createDataFrame([("r", "a", True, 5, 0.5, ["x"]), ("r", "b", None, None, None, [])], "run_id string, image_id string, passed boolean, rank int, safety double, reject_codes array<string>")
    fields = {r.image_id: r.fields for r in explore.sample_fields(table).collect()}
    assert fields == {"a": '{"verdict":"passed","safety":0.5,"refined_rank":5,"reject_codes":["x"]}', "b": '{"verdict":"needs_review"}'}
    assert {r.image_id: r.tags for r in explore.sample_tags(table).collect()} == {"a": ["passed", "refined"], "b": ["needs_review"]}
    tagged = spark.createDataFrame([("a", ["passed", "rating:2"]), ("b", ["needs_review"]), ("z", ["rating:5"])], "image_id string, tags array<string>")
    assert [(r.image_id, r.hitl_rating, r.reject_codes) for r in explore.updates_from_tags(tagged, table).collect()] == [("a", 2, [])]


def test_manifests(spark):
    specs = spark.createDataFrame([("r1", "base", None, [("l2", 0.5), ("l1", 1.0)]), ("r2", "base", "vae", [])], "run_id string, base_checkpoint string, vae string, loras array<struct<name:string,weight:double>>")
    digests = spark.createDataFrame([("base", "hb"), ("vae", "hv"), ("l1", "h1"), ("l2", "h2")], "name string, sha256 string")
    got = {r.run_id: r for r in manifests.with_digests(specs, digests).collect()}
    assert [tuple(x) for x in got["r1"].loras] == [("l2", "h2", 0.5), ("l1", "h1", 1.0)] and got["r2"].vae_sha256 == "hv" and got["r2"].loras == []
    with pytest.raises(Exception, match="not found"):
        manifests.with_digests(specs, digests.where("name <> 'l1'")).collect()
    a = spark.createDataFrame([("r", "p", None)], "run_id string, prompt string, negative_prompt string")
    b = spark.createDataFrame([("r", "q", None)], "run_id string, prompt string, negative_prompt string")
    assert manifests.differences(a, b, ("run_id", "prompt", "negative_prompt")).first().differing == ["prompt"]
    listing = spark.createDataFrame([(1, "m.ckpt", "/b/m.ckpt"), (0, "z/m.ckpt", "/a/z/m.ckpt"), (0, "y/m.ckpt", "/a/y/m.ckpt"), (1, "note.txt", "/b/note.txt")], "root_ord int, rel string, path string")
    assert {r.name: r.path for r in manifests.resolve(spark.createDataFrame([("m.ckpt",), ("gone",)], "name string"), listing).collect()} == {"m.ckpt": "/a/y/m.ckpt", "gone": None}
    assert {r.rel for r in manifests.models(listing).collect()} == {"m.ckpt", "z/m.ckpt", "y/m.ckpt"}


def test_archive(spark, tmp_path):
    import json
    import zipfile

    table = spark.createDataFrame([("r", "a", True, "/p", 1), ("r", "b", False, "/p", 2), ("r", "c", None, "/p", 3), ("r", "d", True, "/p", 4), ("../x", "e", True, "/p", 5)], "run_id string, image_id string, passed boolean, path string, seed int")
    held = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two"))], "image_id string, content binary")
    got = archive.write_archives(table, held, spark.createDataFrame([("r", "m")], "run_id string, engine string"), str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("r", 2, 1, 1, 1, ["d"])]
    more = spark.createDataFrame([("s", "x", False), ("t", "y", True), ("t", "z", True)], "run_id string, image_id string, passed boolean")
    jpg = spark.createDataFrame([("y", bytearray(b"1"), "jpg", "/runs/t/y.jpg"), ("x", bytearray(b"1"), "jpg", "/elsewhere/x.jpg")], "image_id string, content binary, ending string, path string")
    done = {r.run_id: r for r in archive.write_archives(more, jpg, spark.createDataFrame([], "run_id string"), str(tmp_path)).collect()}
    assert not (tmp_path / "s" / "passing_images.zip").exists() and zipfile.ZipFile(tmp_path / "t" / "passing_images.zip").namelist() == ["y.jpg"] and done["t"].missing == ["z"]
    assert [r.path for r in archive.loose_images(more, jpg, "/runs").collect()] == ["/runs/t/y.jpg"]
    assert zipfile.ZipFile(tmp_path / "r" / "passing_images.zip").namelist() == ["a.png"]
    assert json.loads((tmp_path / "r" / "reject_archive.json").read_text()) == [{"run_id": "r", "seed": 2}]


def test_numbers_as_text(spark):
    values = [0.125, 0.375, 2.675, 1234567.5, 0.0005, 1e-4, 1.5e-4, 1e-5, 1.25e-7, 1e7, 12345678.25, 1e15, 1e16, 1.5e22, 0.8, 1.0, 100.0, -2.5e-4, 0.0, -1e20]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", text.fixed(F.col("x"), 2).alias("f"), text.python_float(F.col("x")).alias("s")).collect()
    for r in got:
        assert (r.f, r.s) == (f"{r.x:.2f}", str(r.x))
    loras = spark.createDataFrame([("p", [("loras/subj.safetensors", 1e-4), ("char/v1.2.pt", 0.8)])], "prompt string, loras array<struct<name:string,weight:double>>")
    assert loras.select(text.prompt_with_loras(F.col("prompt"), F.col("loras"))).first()[0] == "p <lora:loras/subj:0.0001> <lora:char/v1.2:0.8>"
    names = ["plain", "it's", 'a "b"', "both ' and \"", "back\\slash"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(text.quoted(F.col("x"))).collect()] == [repr(n) for n in names]


def test_scorers(spark):
    def gone():
        raise ImportError("no model")

    table = spark.createDataFrame([("a", 0.2), ("b", None)], "image_id string, raw double")
    good = scoring.Scorer("clip", "clip_score", lambda: F.col("raw"), "2")
    registry = scoring.Registry().add(good, scoring.Scorer("face", "identity", lambda: F.lit(1.0), probe=gone))
    assert [tuple(r)[1:] for r in registry.listing(spark).orderBy("ord").collect()] == [("clip", "clip_score", "2", True), ("face", "identity", None, False)]
    got = {r.image_id: r for r in scoring.score(table, registry.parts).collect()}
    assert (got["a"].clip_score, got["b"].clip_score, got["a"].identity) == (0.2, None, None) and [s.name for s in got["a"].scorers] == ["clip"]
    assert scoring.provenance_text(registry.parts) == "clip@2" and scoring.provenance_text([]) is None and registry.get("face").metric == "identity"
    for bad, text_ in (([good, good], "same metric"), ([scoring.Scorer("x", "sharpness", lambda: F.lit(0.1))], "no metric")):
        with pytest.raises(ValueError, match=text_):
            scoring.score(table, bad)
    for value in (1.5, float("nan")):
        with pytest.raises(Exception, match="out of range"):
            scoring.score(table, [scoring.Scorer("x", "safety", lambda v=value: F.lit(v))]).collect()


def test_detectors(spark):
    def flaky(item):
        if "bad" in item:
            raise RuntimeError("down")
        return {"hate": 2.0}

    def stub(item):
        raise NotImplementedError

    items = spark.createDataFrame([(1, "fine"), (2, "bad")], "item_id long, text string")
    found = scoring.detect(items, [scoring.Detector("flaky", flaky), scoring.Detector("steady", lambda t: {"hate": 0.25}), scoring.Detector("off", stub, probe=lambda: False)])
    assert {(r.item_id, r.category): r.score for r in moderation.combine(found).collect()} == {(1, "hate"): 1.0, (2, "hate"): 0.25}
    with pytest.raises(Exception, match="NotImplementedError"):
        scoring.detect(items, [scoring.Detector("stub", stub)]).collect()
    unsafe = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9), (2, "a", None), (3, "a", -0.5), (4, "a", float("nan"))], "item_id long, detector string, unsafe double")
    safety = {r.item_id: r.safety for r in scoring.ensemble_safety(unsafe).collect()}
    assert safety[1] == pytest.approx(0.1) and safety[2] is None and safety[3] == 1.0 and math.isnan(safety[4])


def test_small_operators(spark, tmp_path):
    faces = spark.createDataFrame([("a", 0, 0, 2, 2, [1.0]), ("a", 5, 5, 9, 9, [2.0]), ("a", 0, 0, 4, 4, [3.0])], "image_id string, x1 int, y1 int, x2 int, y2 int, embedding array<double>")
    assert scoring.largest_face(faces).first().embedding == [3.0]
    made = spark.createDataFrame([("r", 0, 7, None), ("r", 1, 7, None), ("r", 2, 8, "own"), ("r", 3, 9, "own")], "run_id string, ord int, seed long, image_id string")
    assert {r.ord: r.image_id for r in scoring.unique_ids(made).collect()} == {0: "r-7", 1: "r-7-1", 2: "own", 3: "own-3"}
    texts = ["aGk=", "data:image/png;base64,aGk=", "a Gk=", "aGk", "", None]
    assert [None if r[0] is None else bytes(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "x string").select(scoring.decode_image(F.col("x"))).collect()] == [b"hi", b"hi", None, None, b"", None]
    cells = grid.experiment_cells(spark.createDataFrame([(0, "base.ckpt")], "base_pos int, base string"), spark.createDataFrame([(0, "fast", None), (1, "slow", 9.0)], "step_pos int, step string, seconds double"), 4)
    items = grid.prompt_items(grid.base_prompts(spark.createDataFrame([(0, "p"), (1, "q")], "pos int, prompt string")), grid.token_combos(spark, {}))
    runs = grid.experiment_runs(cells, items, spark.createDataFrame([(0, "l")], "lora_pos int, lora string"), spark.createDataFrame([(0, 1.0)], "weight_pos int, weight double"), {"caption": "long"})
    assert {r.run_id: r.labels for r in runs.where("step_config = 'slow'").collect()} == {f"exp-c01-base-slow-l00-w00-p00{i}": '{"caption":"long","step_config":"slow"}' for i in (0, 1)}
    assert grid.images_per_cell(runs, 4).first().per_cell == {"exp-c00-base-fast": 8, "exp-c01-base-slow": 8}
    rolled = rollup.verdicts(rollup.roll_up(rollup.gate(images(spark, [("r", "a", 0.9, None), ("r", "b", 0.1, None)]))))
    assert rolled.select(scoring.digest_line(rolled)).first()[0] == "r: FAILED \u2014 pass rate 50% (1/2 groups, 2 images, 0 need review)"
    found = spark.createDataFrame([("grid", "low", "widen", "diversity", 0.125, 0.3), ("refine", "open", "look", None, None, None)], "stage string, issue string, action string, metric string, value double, threshold double")
    assert [r[0] for r in found.select(scoring.recommendation_line(found)).collect()] == ["[grid] low [diversity 0.12 vs 0.30]: widen", "[refine] open: look"]
    for name, body in (("one", "a\n\nb\n"), ("two", "")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.jsonl").write_text(body)
    (tmp_path / "one" / "references").mkdir()
    (tmp_path / "none").mkdir()
    assert [tuple(r) for r in files.exports(spark, str(tmp_path)).collect()] == [("one", 2, True), ("two", 0, False)]
    (tmp_path / "one" / "references" / "B.PNG").write_bytes(b"x")
    (tmp_path / "one" / "references" / "_a.jpg").write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.reference_images(spark, str(tmp_path / "one" / "references")).collect()] == ["B.PNG", "_a.jpg"]
    assert files.save_manifests(spark.createDataFrame([("m-1", "e")], "run_id string, engine string"), str(tmp_path / "runs")).count() == 1
    assert [r.run_id for r in files.manifests(spark, str(tmp_path / "runs")).collect()] == ["m-1"]
    document = files.schema_document({"cells": cells, "runs": runs})
    assert not files.is_stale(document, {"runs": runs, "cells": cells}) and files.is_stale(document, {"cells": cells}) and files.is_stale(None, {})


@pytest.mark.parametrize("block", [7, 2048])
def test_agreement_of_many_values(spark, monkeypatch, block):
    """Ordinal and ratio agreement of thousands of values, one unit rated very often, against all pairs."""
    import numpy as np

    monkeypatch.setattr(review, "BLOCK", block)
    rng = np.random.default_rng(3)
    units = {u: (rng.uniform(0, 100) + rng.normal(0, 5, 3)).tolist() for u in range(600 if block > 7 else 40)} | {-1: rng.uniform(0, 100, 700 if block > 7 else 60).tolist(), -2: [5.0], -3: [0.0, 0.0, 4.0, 4.0]}
    table = spark.createDataFrame([(u, i, x) for u, xs in units.items() for i, x in enumerate(xs)], "unit_id long, rater int, rating double")
    paired = {u: np.array(xs) for u, xs in units.items() if len(xs) > 1}
    every = np.concatenate(list(paired.values()))
    n = len(every)
    values, t = np.unique(every, return_counts=True)
    middle = np.cumsum(t) - t / 2

    def ordinal(a, b):
        return (middle[np.searchsorted(values, a)] - middle[np.searchsorted(values, b)]) ** 2

    def ratio(a, b):
        return np.where(a + b == 0, 0, (a - b) / np.where(a + b == 0, 1, a + b)) ** 2

    for level, d in (("ordinal", ordinal), ("ratio", ratio)):
        o = sum(d(x[:, None], x[None, :]).sum() / (len(x) - 1) for x in paired.values()) / n
        want = 1 - o / (d(every[:, None], every[None, :]).sum() / (n * (n - 1)))
        got = review.krippendorff_alpha(table, level).first()
        assert (got.alpha, got.n_ratings, got.n_units) == (pytest.approx(want, rel=1e-9), n, len(paired))


def test_ids_that_are_made_count_as_seen(spark):
    made = spark.createDataFrame([("r", 0, 7, None), ("r", 1, 7, None), ("r", 2, 8, "r-7-1"), ("r", 3, 9, "r-7-1-2"), ("r", 4, 9, "r-7-1-2"), ("s", 0, 1, "s-7-1"), ("s", 1, 7, "s-7"), ("t", 1, 0, "x"), ("t", 2, 0, "x-1")], "run_id string, ord int, seed int, image_id string")
    seen, want = set(), {}
    for r in sorted(made.collect()):
        i = r.image_id or f"{r.run_id}-{r.seed}"
        i = f"{i}-{r.ord}" if (r.run_id, i) in seen else i
        seen.add((r.run_id, i))
        want[r.run_id, r.ord] = i
    assert {(r.run_id, r.ord): r.image_id for r in scoring.unique_ids(made).collect()} == want
    assert want["r", 2] == "r-7-1-2" and want["r", 3] == "r-7-1-2-3" and want["t", 2] == "x-1"
    ends = spark.createDataFrame([("aGk=",), ("aGk=\n",), ("data:x,aGk=\n",)], "x string")
    assert [r[0] is None for r in ends.select(scoring.decode_image(F.col("x"))).collect()] == [False, True, True]


def test_rules_go_to_the_runs(spark):
    """Neither the runs nor a row for each of their measures is shuffled for the rules; a rule about nothing does not fire."""
    runs = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 0.5), ("c", float("nan"), None)], "run_id string, x double, y double")
    rules = spark.createDataFrame([(1, "s", "m", "x", "below", 2.0, "x", None, "i", "a"), (2, "s", "m", "x", "above", 2.0, "y", "y", "i", "a"), (3, "s", "m", "z", "below", 9.0, "x", None, "i", "a"), (4, "s", "m", None, "holds", None, "x", None, "i", "a")], acceptance.RULE)
    fired = acceptance.recommend_by(runs, rules)
    assert sorted((r.run_id, r.ord, str(r.value)) for r in fired.collect()) == [("a", 1, "1.0"), ("c", 1, "nan"), ("c", 2, "None")]
    assert "hashpartitioning" not in fired._jdf.queryExecution().executedPlan().toString()
