"""Build-cache manifests: keys, reasons for misses, and pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DESCRIPTORS = r"(pom\.xml|build\.gradle|build\.gradle\.kts|settings\.gradle|settings\.gradle\.kts)$"
WRAPPERS = r"(mvnw|gradlew)$"
LOCKFILES = r"gradle\.lockfile$"


def input_class(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike(DESCRIPTORS), "descriptor").when(low.rlike(WRAPPERS), "wrapper").when(low.rlike(LOCKFILES), "lockfile").otherwise("source")


#: Entries of a decision history that are kept.
HISTORY = 10


def cache_keys(inputs: DataFrame, tool: str) -> DataFrame:
    """A tool's key for each module (module_id): sha256 of tool, module and its inputs (path, digest)
    in the order of paths."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat_ws(":", x["path"], x["digest"])), "|")
    rows = inputs.groupBy("module_id").agg(lines.alias("lines"), F.count("*").alias("input_count"))
    return rows.select("module_id", F.sha2(F.concat_ws("|", F.lit(tool), "module_id", "lines"), 256).alias("cache_key"), "input_count")


def miss_reasons(before: DataFrame, now: DataFrame) -> DataFrame:
    """Sorted reasons for each module whose inputs (module, path, digest) differ from before."""
    joined = before.withColumnRenamed("digest", "was").join(now.withColumnRenamed("digest", "is"), ["module", "path"], "full").where(~F.col("was").eqNullSafe(F.col("is")))
    return joined.groupBy("module").agg(F.array_sort(F.collect_set(F.concat(input_class(F.col("path")), F.lit("_hash_changed")))).alias("reasons"))


def totals(manifests: DataFrame) -> DataFrame:
    """Hits, misses and hit rate over manifests (project, last_status); a project without either has
    no rate."""
    hits, misses = F.count_if(F.col("last_status") == "hit"), F.count_if(F.col("last_status") == "miss")
    return manifests.groupBy("project").agg(hits.alias("hits"), misses.alias("misses"), F.when(hits + misses > 0, F.round(hits / (hits + misses) * 100, 2)).alias("hit_rate_percent"))


def roll_up(results: DataFrame) -> DataFrame:
    """Over a run's results (project, run_id, tool, cached_modules, cache_hits, cache_misses,
    miss_reason_counts map<string,long>, last_cache_update): totals, rate, reasons, the last update, and
    hits, misses and reasons of each tool, in the order of tools."""
    run = ["project", "run_id"]
    sums = results.groupBy(*run, "tool").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("cached_modules", "cache_hits", "cache_misses")), F.max(F.when(F.col("last_cache_update") != "", F.col("last_cache_update"))).alias("updated"))
    reasons = results.select(*run, "tool", F.explode("miss_reason_counts").alias("reason", "n")).where("n IS NOT NULL").groupBy(*run, "tool", "reason").agg(F.sum("n").alias("n"))
    listed = lambda rows, key: rows.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("miss_reason_counts"))
    none = F.create_map().cast("map<string,bigint>")
    own = sums.join(listed(reasons, [*run, "tool"]), [*run, "tool"], "left").withColumn("miss_reason_counts", F.coalesce("miss_reason_counts", none))
    tools = F.array_sort(F.collect_list(F.struct("tool", F.col("cache_hits").alias("hits"), F.col("cache_misses").alias("misses"), "miss_reason_counts")), lambda a, b: F.when(a["tool"] < b["tool"], -1).when(a["tool"] > b["tool"], 1).otherwise(0))
    totals_ = own.groupBy(*run).agg(*(F.sum(c).alias(c) for c in ("cached_modules", "cache_hits", "cache_misses")), F.max("updated").alias("last_cache_update"), tools.alias("tools"))
    whole = listed(reasons.groupBy(*run, "reason").agg(F.sum("n").alias("n")), run)
    every = F.col("cache_hits") + F.col("cache_misses")
    return totals_.join(whole, run, "left").withColumn("miss_reason_counts", F.coalesce("miss_reason_counts", none)).withColumn("hit_rate_percent", F.when(every > 0, F.round(F.col("cache_hits") / every * 100, 2)))


def saved(manifests: DataFrame, decision: Column) -> DataFrame:
    """Manifests with a decision (timestamp, status, reasons, previous_cache_key, current_cache_key)
    added to their decision_history, of which the last entries stay."""
    return manifests.withColumns({"decision_history": bounded_history(F.array_append(F.coalesce("decision_history", F.array()), decision)), "last_status": decision["status"], "last_reasons": decision["reasons"]})


def bounded_history(history: Column, most: int = HISTORY) -> Column:
    """The last entries of a decision history."""
    return F.when(F.size(history) > most, F.slice(history, -most, most)).otherwise(history)


def cleared(manifests: DataFrame, modules: DataFrame, module_name: str | None = None, tool: str | None = None) -> DataFrame:
    """The manifests (project, module_id, tool) that clearing removes: of modules that are known, of one
    by name, of one tool, as asked."""
    chosen = modules.where(F.col("module_name") == module_name) if module_name is not None else modules
    held = manifests.join(chosen.select("project", "module_id", "module_name"), ["project", "module_id"])
    return held.where(F.col("tool") == tool) if tool is not None else held


def pruned(manifests: DataFrame, modules: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Manifests (project, module_id, tool, created_at) to delete: of modules that are gone, or too old.
    One that tells no time stays."""
    if days < 1:
        raise ValueError("days must be at least 1")
    known = modules.select("project", "module_id").withColumn("known", F.lit(True))
    reason = F.when(F.col("known").isNull(), "orphan").when(F.col("created_at") < now - F.expr(f"interval {days} days"), "age")
    return manifests.join(known, ["project", "module_id"], "left").withColumn("reason", reason).where("reason is not null").drop("known")


def known_tools(manifests: DataFrame) -> DataFrame:
    """The tools that any manifest of a project is of."""
    return manifests.select("project", "tool").distinct()


def unreferenced(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifacts (project, path, bytes) that no manifest (project, artifact_paths) names."""
    return artifacts.join(manifests.select("project", F.explode("artifact_paths").alias("path")).distinct(), ["project", "path"], "left_anti")


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files of each folder (project, folder, bytes)."""
    return files.groupBy("project", "folder").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("files"))


def trimmed(history: Column, now: Column, days: int = 30, most: int = HISTORY) -> Column:
    """A decision history without entries too old (one that tells no time stays), the last of them."""
    since = now - F.expr(f"interval {days} days")
    return bounded_history(F.filter(history, lambda x: F.coalesce(F.try_to_timestamp(x["timestamp"]) >= since, F.lit(True))), most)
