"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of every text is addressed by the SHA-256 of its content, and every
rule by a digest of what it says. The ledger tells which (blob, rule version)
pairs have been scanned, and the spans found. A scan works out the pairs that are
not there, reads only the texts that have any, applies only the missing rules,
appends the findings, and joins the ledger back to all rows that carry a blob.

Positions come from splitting a text at a rule's matches: a match starts after
the summed lengths of what lies before it. Lengths count code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        """A digest of the rule: another pattern is another version."""
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


# The patterns of the three base kinds, in the order that breaks ties of position.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that later versions of the rules add; base spans stay as they are.
ADDED = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"\bgh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPANS = "array<struct<start:int,kind:int,stop:int>>"
FINDINGS = "array<struct<start:int,kind:string,version:string,stop:int>>"
#: A session that sets this keeps one ledger there; else every report begins a new one.
SETTING = "evalspark.secrets.ledger"


#: Matches, or spans, that are worked on at once: what grows with each of them is never longer than this.
STRETCH = 256


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _stretches(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STRETCH).cast("int")), lambda c: F.slice(items, c * STRETCH + 1, STRETCH))


def _before(totals: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each stretch what all earlier ones come to."""
    return F.transform(totals, lambda _, i: F.aggregate(F.slice(totals, 1, i), zero, add))


def _found(text: Column, number: int, rule: Rule) -> Column:
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    both = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))

    def measured(x: Column) -> Column:
        held = F.regexp_extract(x["match"], rule.pattern, rule.group) if rule.group else x["match"]
        return F.struct(x["gap"].alias("gap"), F.length(x["match"]).alias("size"), (F.length(held) >= rule.least).alias("counts"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), (start + x["size"]).alias("stop")))
        spans = F.when(x["counts"], F.concat(state["spans"], one)).otherwise(state["spans"])
        return F.when(x["size"].isNull(), state).otherwise(F.struct((start + x["size"]).alias("at"), spans.alias("spans")))

    def spans(stretch: Column, at: Column) -> Column:
        return F.aggregate(stretch, F.struct(at.alias("at"), F.array().cast(SPANS).alias("spans")), step, lambda s: s["spans"])

    def located(stretches: Column) -> Column:
        length = lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["size"], F.lit(0)))
        starts = _bound(F.transform(stretches, length), lambda totals: _before(totals, F.lit(0), lambda a, b: a + b))
        return F.flatten(F.zip_with(stretches, starts, spans))

    found = _bound(F.transform(both, measured), lambda items: _bound(_stretches(items), located))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPANS))


def find_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All spans of a text by start, then by the rules' order; ends are exclusive."""
    return F.array_sort(F.concat(*[_found(text, i, r) for i, r in enumerate(rules)]))


def describe(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span replaced; a span that begins inside an earlier one extends it."""

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], _slice(state["rest"], state["at"] - state["from"], s["start"] - state["from"]), F.lit(mark))
        masked = F.when(s["start"] >= state["at"], fresh).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), masked.alias("out"), state["rest"].alias("rest"), state["from"].alias("from"))

    def masked(stretch: Column, at: Column) -> Column:
        # The text from where earlier spans end to the last span of the stretch.
        rest = _slice(text, at, F.greatest(at, stretch[F.size(stretch) - 1]["start"]))
        return F.aggregate(stretch, F.struct(at.alias("at"), F.lit("").alias("out"), rest.alias("rest"), at.alias("from")), step, lambda s: s["out"])

    def whole(stretches: Column) -> Column:
        furthest = lambda s: F.aggregate(s, F.lit(0), lambda m, x: F.greatest(m, x["stop"]))
        ends = F.transform(stretches, furthest)
        starts = _bound(ends, lambda e: _before(e, F.lit(0), lambda a, b: F.greatest(a, b)))
        return F.concat(F.array_join(F.zip_with(stretches, starts, masked), ""), _slice(text, F.array_max(ends), F.length(text)))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, _bound(_stretches(spans), whole)).otherwise(text)


def _slice(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(stop - start, F.lit(0)))


class BlobLedger:
    """Scanned (blob, rule version) pairs with their spans, as an append-only Parquet table.

    A row holds the versions that one scan applied to one blob. Two scans at once
    may both append a pair; readers count a finding once.
    """

    SCHEMA = f"blob string, versions array<string>, findings {FINDINGS}"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "ledger")
        self.path = path or spark.conf.get(SETTING, None) or f"{self.scratch.root}/blobs"

    def exists(self) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def missing(self, blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
        """``blob, missing`` of the distinct ``blobs(blob)`` that lack any of the rules' versions."""
        wanted = F.array(*[F.lit(r.version) for r in rules])
        blobs = blobs.distinct()
        if not self.exists():
            return blobs.withColumn("missing", wanted)
        # The versions of a blob are few: as many as rules have ever had.
        seen = self.table().select("blob", F.explode("versions").alias("version")).where(F.col("version").isin(*[r.version for r in rules])).groupBy("blob").agg(F.collect_set("version").alias("seen"))
        lacking = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", lacking.alias("missing")).where(F.size("missing") > 0)

    def update(self, texts: DataFrame, rules: Sequence[Rule] = RULES) -> None:
        """Apply to each of ``texts(blob, text)`` the rules that the ledger does not yet have for it."""
        fresh = not self.exists()
        if not fresh:
            # Written, so that Spark knows its size: texts move only if very many are new.
            texts = texts.join(self.scratch.save(self.missing(texts.select("blob"), rules), "missing"), "blob")
        else:
            texts = texts.withColumn("missing", F.array(*[F.lit(r.version) for r in rules]))
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("missing").alias("versions"))

        def findings(r: Rule) -> Column:
            named = F.transform(_found(F.col("text"), 0, r), lambda s: F.struct(s["start"], F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), s["stop"]))
            return named if fresh else F.when(F.array_contains("versions", r.version), named).otherwise(F.array().cast(FINDINGS))

        blobs.select("blob", "versions", F.concat(*[findings(r) for r in rules]).cast(FINDINGS).alias("findings")).write.mode("append").parquet(self.path)
        self.scratch.sweep()

    def spans(self, rules: Sequence[Rule] = RULES) -> DataFrame:
        """``blob, spans`` of the blobs in which these versions of the rules have found any."""
        held = self.table().where(F.size("findings") > 0).groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings"))
        wanted = F.filter("findings", lambda f: f["version"].isin(*[r.version for r in rules]))
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        spans = F.transform(wanted, lambda f: F.struct(f["start"].alias("start"), (F.array_position(kinds, f["kind"]) - 1).cast("int").alias("kind"), f["stop"].alias("stop")))
        return held.select("blob", F.array_sort(F.array_distinct(spans)).alias("spans")).where(F.size("spans") > 0)


def _addressed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_blob").alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: Sequence[Rule] = RULES + ADDED) -> DataFrame:
    """All rows of ``docs(text, ...)`` with the spans that their texts hold.

    Adds ``blob`` (SHA-256 of the text) and ``spans``, whose ``kind`` is the rule's
    place in ``rules``; a column of either name is replaced. A null text is an
    empty one; both hold no spans. Repeated rows and copies of a text are scanned
    once and answered each. Without a ledger the session's is used, or a new one
    begun, in which nothing has been seen. Secrets never leave the scan: the ledger
    holds positions, not matches. An empty table gives an empty table.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    rows = _addressed(docs.drop("blob", "spans"))
    ledger.update(_texts(rows), rules)
    joined = rows.join(ledger.spans(rules).withColumnRenamed("blob", "_blob"), "_blob", "left")
    return joined.select(*[c for c in rows.columns if c != "_blob"], F.col("_blob").alias("blob"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secret_report(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row: counts and digest of the base kinds, list of all.

    The scan takes two steps over one ledger. A first batch, the texts of even
    hash, meets the base rules; then all texts meet base and added rules, and only
    the pairs that the first step has not left are worked on. Null and empty texts
    hold nothing; every row is answered, whatever its doc_id.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ledger.update(_texts(_addressed(rows.where(F.xxhash64("text") % 2 == 0))), RULES)
    out = scan_secrets(rows, ledger).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < len(RULES))

    def of_kind(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    counts = [of_kind(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    every = RULES + ADDED
    return out.select("doc_id", *counts, F.sha2(describe(base, every), 256).alias("base_sha256"), describe(F.col("spans"), every).alias("spans"))


def _oracle_sql() -> str:
    """The report as SQL: a match starts after all gaps and matches before it."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    every = RULES + ADDED
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, {quoted(r.pattern)}) AS whole, "
        f"regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS held, string_split_regex(text, {quoted(r.pattern)}) AS gaps FROM t"
        for i, r in enumerate(every)
    )
    counts = ", ".join(f"count(*) FILTER (k = {i}) AS n_{r.kind}" for i, r in enumerate(RULES))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
p AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM f),
m AS (SELECT doc_id, k, kind, whole[i] AS found,
             (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start
      FROM p WHERE length(held[i]) >= least),
s AS (SELECT doc_id, k, start, kind || ':' || start || ':' || (start + length(found)) AS span FROM m),
a AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, k) FILTER (k < {len(RULES)}) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON a.doc_id = t.doc_id
"""


ORACLE = _oracle_sql()
