"""Fleet reports: totals, failure classes, coverage, drills, ledgers and fault sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROKEN_RUNS, BROKEN_RATE, SHOWN_SEEDS = 20, 0.9, 8


def fleet_summary(runs: DataFrame) -> DataFrame:
    """(workload, runs, failed, node_nanos, broken), a row for each workload and one, null, for all."""
    r = runs.rollup("workload").agg(F.count("*").alias("runs"), F.count_if("violated").alias("failed"), F.sum("node_nanos").alias("node_nanos"))
    return r.withColumn("broken", (F.col("runs") >= BROKEN_RUNS) & (F.col("failed") > BROKEN_RATE * F.col("runs")))


def failure_classes(runs: DataFrame) -> DataFrame:
    """(workload, invariant, signature, n, seeds): distinct classes with the first seeds of each."""
    f = runs.where("violated")
    keys = ["workload", "invariant", "signature"]
    n = f.groupBy(*keys).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seed"))
    few = f.withColumn("rank", rank).where(F.col("rank") <= SHOWN_SEEDS).groupBy(*keys).agg(F.array_sort(F.collect_list("seed")).alias("seeds"))
    return n.join(few, keys)


def known_classes(classes: DataFrame, rules: DataFrame) -> DataFrame:
    """Classes with `cause`: that of the first rule (rank, workload, invariant, part, cause) whose part is in the signature."""
    r = F.broadcast(rules.select(F.col("workload").alias("rw"), F.col("invariant").alias("ri"), "part", "rank", "cause"))
    hit = classes.join(r, (F.col("workload") == F.col("rw")) & (F.col("invariant") == F.col("ri")) & F.col("signature").contains(F.col("part")), "left")
    return hit.groupBy("workload", "invariant", "signature").agg(F.min_by("cause", "rank").alias("cause"))


def site_coverage(activations: DataFrame, sites: DataFrame) -> DataFrame:
    """One row (sites, covered, enough): sites of the source that some shard activated; enough from 95 %."""
    on = activations.groupBy("site").agg(F.bool_or(F.col("activations") > 0).alias("on"))
    s = sites.join(on, "site", "left").agg(F.count("*").alias("sites"), F.count_if("on").alias("covered"))
    return s.withColumn("enough", 100 * F.col("covered") >= 95 * F.col("sites"))


def mutation_score(drills: DataFrame) -> DataFrame:
    """One row (must_detect, caught, silent_controls, invisible) of drills (must_detect, caught, control, client_visible)."""
    return drills.agg(
        F.count_if("must_detect").alias("must_detect"),
        F.count_if(F.expr("must_detect and caught")).alias("caught"),
        F.count_if(F.expr("control and not caught")).alias("silent_controls"),
        F.count_if(F.expr("caught and not client_visible")).alias("invisible"),
    )


def ledger_tally(entries: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: ledger entries, those with a seed, and of those how many failed before and passed after their fix."""
    j = entries.join(checks, "id", "left")
    return j.agg(F.count("*").alias("entries"), F.count("seed").alias("seeded"), F.count_if("failed_before").alias("failed_before"), F.count_if(F.expr("failed_before and passed_after")).alias("verified"))


def minimal_sets(failing: DataFrame) -> DataFrame:
    """Failing feature sets (set_id, features) none of whose proper subsets fails too."""
    a = failing.select(F.array_sort("features").alias("features")).distinct()
    b = a.select(F.col("features").alias("sub"))
    smaller = (F.size("sub") < F.size("features")) & (F.size(F.array_except("sub", "features")) == 0)
    # equal sets have the same answer, so each is compared once
    lead = a.select("features", F.explode("features").alias("f")).join(b.select("sub", F.explode("sub").alias("f")), "f").where(smaller).select(F.col("features").alias("larger")).distinct()
    empty = failing.where("size(features) = 0").limit(1).select(F.lit(True).alias("none"))
    out = failing.select("set_id", "features").join(lead, F.array_sort("features") == F.col("larger"), "left_anti").join(F.broadcast(empty), F.lit(True), "left")
    return out.where("none is null or size(features) = 0").drop("none")


def complements(sets: DataFrame, universe) -> DataFrame:
    return sets.withColumn("complement", F.array_except(universe, "features"))


def symbol_rules(symbols: DataFrame, excuses: DataFrame, rules: DataFrame, today) -> DataFrame:
    """(object, symbol, verdict) of undefined strong symbols: excuse before first matching rule before allowed.

    Excuses (object, symbol, expires); rules (rank, pattern, verdict), regular expressions tried in rank order; an
    expired excuse is a violation.
    """
    e = excuses.select("object", "symbol", F.col("expires"))
    strong = symbols.where("kind = 'U'").join(F.broadcast(e), ["object", "symbol"], "left")
    r = strong.join(F.broadcast(rules), F.regexp_like("symbol", F.col("pattern")), "left")
    first = r.groupBy("object", "symbol", "expires").agg(F.min_by("verdict", "rank").alias("rule"))
    verdict = F.when(F.col("expires") >= F.lit(today), "excused").when(F.col("expires").isNotNull(), "expired_excuse").otherwise(F.coalesce("rule", F.lit("allowed")))
    return first.select("object", "symbol", verdict.alias("verdict"))
