"""Findings: ranking, merging, the reproduction gate, the cross-derivation guard, known non-issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import handle_set, non_issue_key, normal_claim, prefixes

TIERS = {"ambiguous": 0, "deterministic_single": 1, "mechanical_fact": 1, "no_signal": 2}
BUCKETS = {"high": 2, "med": 1, "low": 0}
CANDIDATE, DOWNGRADE = "deterministic_single", "ambiguous"


def _lookup(c: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def blast(findings: DataFrame, magnitude: DataFrame) -> DataFrame:
    """findings(id, handles) with blast: the largest magnitude(handle, value) of its handles, 0.0 for none."""
    each = findings.select("id", F.explode_outer("handles").alias("handle")).join(magnitude, "handle", "left")
    top = each.groupBy("id").agg(F.coalesce(F.max("value"), F.lit(0.0)).cast("double").alias("blast"))
    return findings.join(top, "id")


def rank(findings: DataFrame, buckets: dict[str, str], priors: dict[str, float]) -> DataFrame:
    """findings(id, axis, grade, blast, ...) with the keys they are ordered by: tier ascending, then bucket, blast and prior
    descending, then id (input order). Blast orders only within a bucket, the prior only within equal blast. An unknown
    axis is in the low bucket with the least prior; an unknown grade in the last tier."""
    tier = _lookup(F.col("grade"), TIERS, 2).alias("tier")
    bucket = _lookup(F.col("axis"), {a: BUCKETS[b] for a, b in buckets.items()}, 0).alias("bucket")
    prior = _lookup(F.col("axis"), priors, min(priors.values(), default=0.0)).cast("double").alias("prior")
    return findings.select("*", tier, bucket, prior).orderBy("tier", F.desc("bucket"), F.desc("blast"), F.desc("prior"), "id")


def _key() -> Column:
    return F.sha2(F.to_json(F.struct(handle_set(F.col("handles")).alias("h"), F.coalesce("grade", F.lit("")).alias("g"), normal_claim(F.col("claim")).alias("c"))), 256)


def merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    """All of prior, its own duplicates included, then the first of each kind of new finding that prior has no equivalent of:
    same handle set, grade and normal claim. Adds origin (0 prior, 1 new); order by (origin, id)."""
    keyed = new.withColumn("_k", _key())
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("id"))).where("_r = 1").drop("_r")
    fresh = first.join(prior.select(_key().alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return prior.withColumn("origin", F.lit(0)).unionByName(fresh.withColumn("origin", F.lit(1)))


def reproduction_gate(findings: DataFrame, reruns: DataFrame, runs: int = 3) -> DataFrame:
    """findings whose candidates (grade deterministic_single) keep it only if each of `runs` reruns has an equivalent;
    reruns(id of the candidate, run, handles, grade, claim). Others pass as they are."""
    if runs < 1:
        raise ValueError(f"runs must be at least 1, got {runs}")
    seen = reruns.where(F.col("run").between(0, runs - 1)).select(F.col("id").alias("_id"), "run", _key().alias("_rk")).distinct()
    mine = findings.select(F.col("id").alias("_i"), _key().alias("_fk"))
    stable = mine.join(seen, (F.col("_i") == F.col("_id")) & (F.col("_fk") == F.col("_rk"))).groupBy("_i").agg(F.count_distinct("run").alias("_n")).where(F.col("_n") == runs)
    out = findings.join(stable.select("_i", F.lit(True).alias("_ok")), F.col("id") == F.col("_i"), "left").drop("_i")
    return out.withColumn("grade", F.when((F.col("grade") == CANDIDATE) & F.col("_ok").isNull(), DOWNGRADE).otherwise(F.col("grade"))).drop("_ok")


def cross_derivation_guard(findings: DataFrame, corroborated: DataFrame) -> DataFrame:
    """Candidates that an independent derivation, corroborated(id), doesn't confirm become ambiguous and are marked as a
    possible extractor bug; the mark is null for all others."""
    ok = corroborated.select(F.col("id").alias("_i")).distinct()
    out = findings.join(ok, F.col("id") == F.col("_i"), "left")
    diverges = (F.col("grade") == CANDIDATE) & F.col("_i").isNull()
    return out.withColumn("possible_extractor_bug", F.when(diverges, F.lit(True))).withColumn("grade", F.when(diverges, DOWNGRADE).otherwise(F.col("grade"))).drop("_i")


def corroborated_by_imports(findings: DataFrame, written: DataFrame) -> DataFrame:
    """(id) of findings(id, module, target) that module imports target, which the statements themselves confirm:
    written(module, name), or a name below it. For cross_derivation_guard."""
    spelled = written.select(F.col("module").alias("_m"), F.explode(prefixes(F.col("name"))).alias("_n")).distinct()
    return findings.join(spelled, (F.col("module") == F.col("_m")) & (F.col("target") == F.col("_n")), "left_semi").select("id").distinct()


def non_issues(findings: DataFrame) -> DataFrame:
    return findings.select("id", "handles", F.col("claim").alias("structural_fact"), non_issue_key(F.col("handles"), F.col("claim")).alias("key"))


def suppress(findings: DataFrame, known: DataFrame) -> DataFrame:
    """findings without those whose key a person has confirmed as no issue."""
    return findings.withColumn("_k", non_issue_key(F.col("handles"), F.col("claim"))).join(known.select(F.col("key").alias("_k")), "_k", "left_anti").drop("_k")


def stale(coverage: DataFrame, current: DataFrame) -> DataFrame:
    """(unit, is_stale) of coverage(unit, content_hash) against current(unit, content_hash)."""
    now = current.select("unit", F.col("content_hash").alias("_now"))
    return coverage.join(now, "unit").select("unit", (F.col("content_hash") != F.col("_now")).alias("is_stale"))
