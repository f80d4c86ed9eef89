"""Scores, recall and upkeep of tiered memories. The clock is always passed in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the scoring model.
DECAY, TIER_WEIGHT = 0.01, {"working": 1.0, "episodic": 0.8, "semantic": 0.9, "procedural": 1.0}
WORKING_TTL, ARCHIVE_DAYS = 86_400, 90


def wilson_lower_bound(good: Column, n: Column, z: float = 1.96) -> Column:
    """Lower 95 % bound of a share, 0 without trials, within [0, 1]."""
    p = good / n
    lower = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), lower))).otherwise(F.lit(0.0))


def decay(age_days: Column, rate: float = DECAY) -> Column:
    return F.when(age_days <= 0, F.lit(1.0)).otherwise(F.exp(-rate * age_days))


def salience(confidence: Column, recency: Column, accesses: Column) -> Column:
    s = 0.5 * confidence + 0.3 * recency + 0.2 * F.least(F.lit(1.0), F.log2(1 + accesses) / F.log2(F.lit(65.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def final_score(rrf: Column, tier: Column, recency: Column, salience_: Column, specificity: Column, alpha: float = 0.5) -> Column:
    w = F.coalesce(F.create_map(*(F.lit(x) for kv in TIER_WEIGHT.items() for x in kv))[tier], F.lit(1.0))
    return rrf * w * recency * (1 + alpha * salience_) * (1 + 0.25 * specificity)


def budget_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Greedy packing per query in rank order: what doesn't fit is skipped, smaller ones after it
    may still fit. ``ranked`` (query_id, id, rank, cost), a bounded list per query."""
    kind = ranked.schema["id"].dataType.simpleString()
    item = F.array_sort(F.collect_list(F.struct("rank", "id", "cost")))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    g = ranked.withColumn("cost", F.col("cost").cast("bigint")).groupBy("query_id").agg(F.aggregate(item, zero, step).alias("p"))
    return g.select("query_id", F.posexplode("p.ids").alias("position", "id"))


def budget_prefix(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows while the running cost stays within the budget; the first overflow ends the list."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("cost").over(w)).where(F.col("used") <= budget).drop("used")


def live(memories: DataFrame, now: int) -> DataFrame:
    """Memories that hold: not invalidated, and working ones not older than their time to live."""
    fresh = (F.col("tier") != "working") | (F.lit(now) - F.col("created") <= WORKING_TTL)
    return memories.where((F.col("invalid_at").isNull() | (F.col("invalid_at") > now)) & fresh)


def recall(memories: DataFrame, fused: DataFrame, now: int, k: int = 10) -> DataFrame:
    """(query_id, id, tier, score, rank): fused candidates (query_id, id, score) weighed by tier,
    recency and salience; working memories come last."""
    m = live(memories, now)
    age = (F.lit(now) - F.col("created")) / 86_400.0
    r = decay(age)
    s = salience(F.col("confidence"), r, F.col("accesses"))
    j = fused.select("query_id", "id", F.col("score").alias("f")).join(m, "id").withColumn("score", F.round(final_score(F.col("f"), F.col("tier"), r, s, F.lit(0)), 9))
    w = Window.partitionBy("query_id").orderBy(F.col("tier") == "working", F.col("score").desc(), "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "tier", "score", "rank")


def facts(memories: DataFrame) -> DataFrame:
    """(id, fact): sentences of more than three characters, cut at . ! ? and line ends."""
    s = memories.select("id", F.explode(F.split("content", r"[.!?\n]")).alias("s"))
    return s.select("id", F.trim("s").alias("fact")).where(F.length("fact") > 3).distinct()


def entities(memories: DataFrame) -> DataFrame:
    """(id, entity): words with a capital and more than one letter, distinct per memory."""
    return memories.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b[A-Z][A-Za-z0-9]+"), F.lit(0)))).alias("entity"))


def archive(memories: DataFrame, now: int, floor: float) -> DataFrame:
    """(scope, n, first_id, last_id): old memories of low salience, one summary per scope."""
    age = (F.lit(now) - F.col("created")) / 86_400.0
    s = salience(F.col("confidence"), decay(age), F.col("accesses"))
    return memories.where((age >= ARCHIVE_DAYS) & (s < floor)).groupBy("scope").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def promote(memories: DataFrame, least: float, reinforced: int = 5) -> DataFrame:
    """(id, bound): facts reinforced often enough whose Wilson bound reaches ``least``."""
    b = wilson_lower_bound(F.col("good"), F.col("accesses"))
    return memories.where(F.col("good") >= reinforced).select("id", F.round(b, 9).alias("bound")).where(F.col("bound") >= least)


def reinforce(memories: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """Counters raised by the hits (id) of one batch, repeated hits counted each."""
    h = hits.groupBy("id").agg(F.count("*").alias("h"))
    j = memories.join(h, "id", "left")
    up = F.coalesce("h", F.lit(0))
    return j.withColumn("accesses", F.col("accesses") + up).withColumn("good", F.col("good") + up).withColumn("last_access", F.when(F.col("h").isNotNull(), F.lit(now)).otherwise(F.col("last_access"))).drop("h")
