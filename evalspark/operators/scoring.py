"""Scorers and detectors as extension points: what is available, what it measures, and its scores as columns.

A scorer of an image table is a function from the table's columns to a Column, so
it stays in Spark's code; one that calls a Python model wraps a pandas UDF. A
detector is a Python callable from an item's text or path to scores by category.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import METRICS, checked, clamp01
from .components import checkpointed


def _always() -> bool:
    return True


@dataclass(frozen=True)
class Scorer:
    """One metric's measurement; null is 'not measured'."""

    name: str
    metric: str
    score: Callable[[], Column]
    version: str | None = None
    model: str | None = None
    probe: Callable[[], bool] = _always


@dataclass(frozen=True)
class Detector:
    """Scores by category of one item; ``call(item) -> {category: score}`` or None."""

    name: str
    call: Callable[[str], Mapping[str, float] | None]
    version: str | None = None
    probe: Callable[[], bool] = _always


def is_available(part: Scorer | Detector) -> bool:
    """What the probe says; a probe that fails means no."""
    try:
        return bool(part.probe())
    except Exception:  # noqa: BLE001 - a missing library may fail in any way
        return False


@dataclass
class Registry:
    """Named parts, of which the available ones are used."""

    parts: list = field(default_factory=list)

    def add(self, *parts: Scorer | Detector) -> Registry:
        self.parts += parts
        return self

    def available(self) -> list:
        return [p for p in self.parts if is_available(p)]

    def get(self, name: str):
        for p in self.parts:
            if p.name == name:
                return p
        raise ValueError(f"unknown: {name!r}; known are {sorted(p.name for p in self.parts)}")

    def listing(self, spark: SparkSession) -> DataFrame:
        """``ord, name, metric, version, available`` of all parts."""
        rows = [(i, p.name, getattr(p, "metric", None), p.version, is_available(p)) for i, p in enumerate(self.parts)]
        return spark.createDataFrame(rows, "ord int, name string, metric string, version string, available boolean")


def provenance_text(parts: Iterable[Scorer | Detector]) -> str | None:
    """Available parts as ``name@version`` joined by '+'; None without any."""
    return "+".join(p.name + (f"@{p.version}" if p.version else "") for p in parts if is_available(p)) or None


def score(images: DataFrame, scorers: Iterable[Scorer]) -> DataFrame:
    """``images`` with a column for each metric and ``scorers``, the array of what measured them.

    A metric that no available scorer measures is null. An unknown metric and two
    scorers of one metric are refused before anything runs; a value outside [0, 1]
    or NaN is an error when it is read.
    """
    used = [s for s in scorers if is_available(s)]
    for s in used:
        if s.metric not in METRICS:
            raise ValueError(f"{s.name} measures {s.metric!r}, which is no metric")
    if len({s.metric for s in used}) < len(used):
        raise ValueError("two scorers measure the same metric")
    kind = "array<struct<name:string,metric:string,version:string,model:string>>"
    held = [F.struct(F.lit(s.name).alias("name"), F.lit(s.metric).alias("metric"), F.lit(s.version).cast("string").alias("version"), F.lit(s.model).cast("string").alias("model")) for s in used]
    measured = images.withColumns({m: F.lit(None).cast("double") for m in METRICS if m not in {s.metric for s in used}} | {s.metric: s.score().cast("double") for s in used})
    return measured.withColumns({s.metric: checked(s.metric) for s in used} | {"scorers": F.array(*held).cast(kind)})


def detect(items: DataFrame, detectors: Iterable[Detector], column: str = "text") -> DataFrame:
    """``item_id, detector, category, score`` of every available detector over ``items(item_id, <column>)``.

    A detector that fails on an item is passed over for it; one that is not
    implemented is an error, since silence would read as safe.
    """
    used = [d for d in detectors if is_available(d)]
    kind = items.select(F.col("item_id")).dtypes[0][1]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for i, item in zip(batch["item_id"], batch["item"], strict=True):
                for d in used:
                    try:
                        found = d.call(item) or {}
                    except NotImplementedError:
                        raise
                    except Exception:  # noqa: BLE001 - one flaky detector must not end the run
                        continue
                    rows += [(i, d.name, c, float(s)) for c, s in found.items()]
            yield pd.DataFrame(rows, columns=["item_id", "detector", "category", "score"])

    return items.select("item_id", F.col(column).alias("item")).mapInPandas(run, f"item_id {kind}, detector string, category string, score double")


def ensemble_safety(scores: DataFrame) -> DataFrame:
    """``item_id, detector, unsafe`` -> ``item_id, safety``: one less the most unsafe detector's probability; null where none has one.

    NaN and infinities stay, for the metric's check to refuse.
    """
    worst = scores.groupBy("item_id").agg(F.max("unsafe").alias("worst"))  # NaN is the largest
    return worst.select("item_id", clamp01(1.0 - F.col("worst")).alias("safety"))


def largest_face(faces: DataFrame) -> DataFrame:
    """``image_id, x1, y1, x2, y2, embedding`` -> the embedding of each image's largest box; ties to the first box from the left and top."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return faces.groupBy("image_id").agg(F.max_by("embedding", F.struct(area.alias("a"), (-F.col("x1")).alias("x"), (-F.col("y1")).alias("y"))).alias("embedding"))


def unique_ids(produced: DataFrame) -> DataFrame:
    """``run_id, ord, seed[, image_id]`` with ids of their own: one that an earlier image of the run has, as given or as made, gets '-<ord>'.

    ``ord`` tells a run's images apart. A made id can be what a later image is
    named; those are few, and found by joins on the id without its last number.
    """
    given = F.col("image_id") if "image_id" in produced.columns else F.lit(None).cast("string")
    plain = F.coalesce(F.nullif(given, F.lit("")), F.concat_ws("-", F.col("run_id").cast("string"), F.col("seed").cast("string")))
    first = F.min("ord").over(Window.partitionBy("run_id", "_id"))  # the images of one run and id
    named = produced.withColumn("_id", plain).withColumn("_taken", F.col("ord") > first)
    number = r"^(.*)-(-?[0-9]+)$"
    ends = named.where(~F.col("_taken") & F.col("_id").rlike(number)).select(F.col("run_id").alias("_run"), F.col("ord").alias("_ord"), F.regexp_extract("_id", number, 1).alias("_of"), F.regexp_extract("_id", number, 2).alias("_at"))
    maker = (F.col("run_id") == F.col("_run")) & (F.col("_id") == F.col("_of")) & (F.col("ord").cast("string") == F.col("_at")) & (F.col("ord") < F.col("_ord"))
    # Images named like what an earlier one would be made: taken if that one is, which may hang on another such image.
    hangs = checkpointed(named.join(ends, maker).select("_run", "_ord", F.col("ord").alias("_maker"), F.col("_taken").alias("_made")))
    taken = hangs.where("_made").select("_run", "_ord")
    last = taken
    while not last.isEmpty():
        last = checkpointed(hangs.where("not _made").join(last.select("_run", F.col("_ord").alias("_maker")), ["_run", "_maker"]).select("_run", "_ord"))
        taken = taken.unionByName(last)
    also = taken.distinct().withColumn("_also", F.lit(True))
    out = named.join(also, (named["run_id"] == also["_run"]) & (named["ord"] == also["_ord"]), "left")
    clash = F.col("_taken") | F.coalesce("_also", F.lit(False))
    return out.withColumn("image_id", F.when(clash, F.concat_ws("-", "_id", F.col("ord").cast("string"))).otherwise(F.col("_id"))).drop("_id", "_taken", "_run", "_ord", "_also")


def decode_image(encoded: Column) -> Column:
    """Bytes of a base64 text, with or without a ``data:`` prefix; null for anything that is not strict base64."""
    bare = F.when(F.ltrim(encoded).startswith("data:") & F.contains(encoded, F.lit(",")), F.regexp_replace(encoded, r"^[^,]*,", "")).otherwise(encoded)
    strict = bare.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    return F.when(strict, F.unbase64(bare))


def kept_outputs(outputs: DataFrame) -> DataFrame:
    """Produced files without temporary previews."""
    return outputs.where(F.coalesce(F.col("type"), F.lit("")) != "temp")


def image_at(images: DataFrame, run_id: str, position: int) -> DataFrame:
    """The image at a place of its run's report; no row where there is none."""
    return images.where((F.col("run_id") == run_id) & (F.col("ordinal") == position))


def digest_line(runs: DataFrame) -> Column:
    """A run's verdict in one line, from the columns of ``rollup.verdicts``."""
    status = F.when(F.col("run_passed"), "PASSED").when(F.col("pending"), "PENDING").otherwise("FAILED")
    share = F.call_function("format_number", F.col("pass_rate") * 100, F.lit("0"))
    counts = F.format_string("(%d/%d groups, %d images, %d need review)", F.col("n_passed"), F.coalesce("n_groups", "n_images"), F.col("n_images"), F.col("n_needs_hitl"))
    return F.concat(F.col("run_id").cast("string"), F.lit(": "), status, F.lit(" — pass rate "), share, F.lit("% "), counts)


def image_line(images: DataFrame) -> Column:
    """An image's outcome in one line: ``passed, image_id, seed`` and, where there are any, ``hitl_rating`` and the codes of ``reject_reasons``."""
    mark = F.when(F.col("passed").isNull(), "?").when(F.col("passed"), "+").otherwise("-")
    rating = F.when(F.col("hitl_rating").isNotNull(), F.concat(F.lit(" hitl="), F.col("hitl_rating").cast("string"))).otherwise("")
    codes = F.transform("reject_reasons", lambda r: r["code"])
    rejects = F.when(F.coalesce(F.size("reject_reasons"), F.lit(0)) > 0, F.concat(F.lit(" rejects="), F.array_join(codes, ","))).otherwise("")
    return F.concat(F.lit("  ["), mark, F.lit("] "), F.col("image_id").cast("string"), F.lit(" (seed "), F.col("seed").cast("string"), F.lit(")"), rating, rejects)


def digest_lines(runs: DataFrame, images: DataFrame) -> DataFrame:
    """``run_id, line_no, line``: a run's verdict, its reasons, then its images in order; ``runs`` has ``reasons array<string>``."""
    head = runs.select("run_id", F.posexplode(F.concat(F.array(digest_line(runs)), F.transform("reasons", lambda r: F.concat(F.lit("  reason: "), r)))).alias("line_no", "line"))
    reasons = runs.select("run_id", (F.size("reasons") + 1).cast("long").alias("above"))
    place = F.count("*").over(Window.partitionBy("run_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))  # a report's own images
    rows = images.join(reasons, "run_id").select("run_id", (F.col("above") + place).alias("line_no"), image_line(images).alias("line"))
    return head.select("run_id", F.col("line_no").cast("long").alias("line_no"), "line").unionByName(rows)


def report_summaries(runs: DataFrame, images: DataFrame) -> DataFrame:
    """``run_id, run_passed, pending, pass_rate, n_images, n_groups, n_needs_hitl, n_refined``: the entry of each report in a list."""
    refined = images.groupBy("run_id").agg(F.count("refinement").alias("n_refined"))
    out = runs.join(refined, "run_id", "left").withColumn("n_refined", F.coalesce("n_refined", F.lit(0)))
    return out.select("run_id", "run_passed", "pending", "pass_rate", "n_images", "n_groups", "n_needs_hitl", "n_refined", *[c for c in runs.columns if c == "created_at"])


def recommendation_line(found: DataFrame) -> Column:
    """A recommendation in one line, with its figures where it has any."""
    from ..functions.text import fixed

    bar = F.when(F.col("threshold").isNotNull(), F.concat(F.lit(" vs "), fixed(F.col("threshold"), 2))).otherwise("")
    figures = F.when(F.col("metric").isNotNull() & F.col("value").isNotNull(), F.concat(F.lit(" ["), "metric", F.lit(" "), fixed(F.col("value"), 2), bar, F.lit("]"))).otherwise("")
    return F.concat(F.lit("["), "stage", F.lit("] "), "issue", figures, F.lit(": "), "action")
