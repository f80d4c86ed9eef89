"""Documents and their sources, annotations, correspondences between graphs, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, stored
from spandrel.operators import textsearch as T

#: Verbs that say little at the front of a name (fixed values).
LEADING = ("get", "set", "is", "has", "do", "on", "to", "from", "with", "make", "build")
#: Names of types that mean the same in several languages (fixed values).
TYPES = {"STR": ("string", "str", "varchar"), "INT": ("int", "i32", "i64", "long", "integer", "number"), "BOOL": ("bool", "boolean"), "FLOAT": ("float", "f32", "f64", "double"), "VOID": ("void", "unit", "none")}
#: Pairs of kinds that are nearly the same, and somewhat (fixed values).
NEAR = (("function", "method"), ("function", "constructor"))
AKIN = (("class", "struct"), ("class", "trait"), ("class", "interface"), ("struct", "trait"), ("interface", "trait"), ("module", "namespace"))


def name_tokens(c: Column | str) -> Column:
    """Words of a camel or snake name, lower case, one-letter ones and a leading verb dropped."""
    c = F.col(c) if isinstance(c, str) else c
    w = F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^\p{L}\p{N}]+", " ")), " "), lambda x: F.length(x) > 1)
    return F.when(F.element_at(F.concat(w, F.array(F.lit(""))), 1).isin(*LEADING) & (F.size(w) > 1), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1)))).otherwise(w)


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def signature_tokens(signature: Column) -> Column:
    """Words of a signature with two letters or more, types folded across languages."""
    fold = F.create_map(*(F.lit(x) for to, names in TYPES.items() for n in names for x in (n, to)))
    words = F.filter(T.terms(F.coalesce(signature, F.lit(""))), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(fold[w], w)))


def arity(signature: Column) -> Column:
    """Parameters of a signature: commas outside inner brackets and one more; null without any
    parentheses."""
    inner = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    for _ in range(6):  # innermost brackets first; deeper nesting than this is taken as it is
        inner = F.regexp_replace(inner, r"\([^()\[\]{}<>]*\)|\[[^()\[\]{}<>]*\]|\{[^()\[\]{}<>]*\}|<[^()\[\]{}<>]*>", "")
    given = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    return F.when(signature.rlike(r"(?s)\(.*\)"), F.when(F.trim(given) == "", 0).otherwise(F.size(F.split(inner, ","))))


def kind_match(a: Column, b: Column) -> Column:
    """1 for the same kind, 0.8 and 0.6 for nearer and remoter relatives, else 0."""
    pair = F.array_join(F.array_sort(F.array(a, b)), " ")
    said = lambda pairs: pair.isin(*(" ".join(sorted(p)) for p in pairs))
    return F.when(a == b, 1.0).when(said(NEAR), 0.8).when(said(AKIN), 0.6).otherwise(0.0)


def correspond(left: DataFrame, right: DataFrame, k: int = 20, least: float = 0.35, pool: int = 20) -> DataFrame:
    """(symbol, match, score, rank) between two graphs' nodes (symbol, name, kind, signature).

    Distinct names meet by BM25 over their tokens, the best ``pool`` per name and all that tie with
    the last of them; only then are symbols
    looked at: half token overlap, a quarter signature, the rest kind and number of parameters.
    """
    l = left.where(F.col("name").isNotNull()).dropDuplicates(["symbol"])
    r = right.where(F.col("name").isNotNull()).dropDuplicates(["symbol"])
    index = r.select(F.col("name").alias("id")).distinct().select("id", F.size(name_tokens("id")).alias("len"), F.explode(name_tokens("id")).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    queries = l.select(F.col("name").alias("query_id")).distinct().select("query_id", F.explode(name_tokens("query_id")).alias("term"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    met = T.bm25(index, queries, None).withColumn("place", F.rank().over(best)).where(F.col("place") <= pool)
    names = met.select(F.col("query_id").alias("ln"), F.col("id").alias("rn"))
    names = stored(names.select("ln", "rn", jaccard(name_tokens("ln"), name_tokens("rn")).alias("nj")))
    # what a symbol brings is worked out once and not for every pair; numbers stand for symbols, in their order
    mine = lambda df, c: stored(df.orderBy("symbol").select(F.monotonically_increasing_id().alias(f"{c}i"), F.col("symbol").alias(f"{c}symbol"), F.col("name").alias(f"{c}n"), F.col("kind").alias(f"{c}k"), signature_tokens(F.col("signature")).alias(f"{c}s"), arity(F.col("signature")).alias(f"{c}a")))
    a, b = mine(l, "l"), mine(r, "r")
    kinds = a.select("lk").distinct().crossJoin(b.select("rk").distinct()).select("lk", "rk", kind_match(F.col("lk"), F.col("rk")).alias("km")).where(F.col("km") > 0)
    spread = a.drop("lsymbol").repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    j = spread.join(broadcast_if_small(names), "ln").join(broadcast_if_small(b.drop("rsymbol")), "rn").join(F.broadcast(kinds), ["lk", "rk"])
    both = F.size(F.array_intersect("ls", "rs"))
    union = F.size("ls") + F.size("rs") - both
    same_arity = F.coalesce((F.col("la") == F.col("ra")).cast("int"), F.lit(0))
    score = 0.5 * F.col("nj") + 0.25 * F.when(union > 0, both / union).otherwise(F.lit(0.0)) + 0.15 * F.col("km") + 0.10 * same_arity
    j = j.select("li", "ri", F.round(score, 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("li").orderBy(F.desc("score"), "ri")
    j = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    j = j.join(broadcast_if_small(a.select("li", F.col("lsymbol").alias("symbol"))), "li").join(broadcast_if_small(b.select("ri", F.col("rsymbol").alias("match"))), "ri")
    return j.select("symbol", "match", "score", "rank")


def annotation_summary(annotations: DataFrame, cap: int = 20) -> DataFrame:
    """(symbol, n, keys, inline): number, distinct keys and the newest ``cap`` of a node's notes."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), "key", "value")
    a = annotations.withColumn("r", F.row_number().over(w))
    return a.groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.count(F.when(F.col("r") <= cap, 1)).alias("inline"))


def stale_annotations(annotations: DataFrame, cutoff: int) -> DataFrame:
    """Notes last verified before the cutoff; never verified (0 or null) is stale."""
    return annotations.where(F.coalesce("last_verified", F.lit(0)) < cutoff)


def find_by_annotation(nodes: DataFrame, annotations: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Distinct nodes that bear a key (and value), by name."""
    a = annotations.where((F.col("key") == key) & (F.lit(True) if value is None else F.col("value") == value))
    return nodes.join(a.select("symbol"), "symbol", "left_semi").dropDuplicates(["symbol"]).orderBy("name", "symbol")


def replace_source(old: DataFrame, new: DataFrame, old_generation: int, new_generation: int) -> DataFrame:
    """(key, op): write or tombstone for a source replaced by one complete generation. An older
    generation, or the same with other content, is refused; an identical retry writes nothing.
    Both frames are (key, hash)."""
    j = old.select("key", F.col("hash").alias("o")).join(new.select("key", F.col("hash").alias("n")), "key", "full_outer")
    differs = j.where(~F.col("o").eqNullSafe(F.col("n")))
    if new_generation < old_generation:
        raise ValueError("older generation")
    if new_generation == old_generation and not differs.isEmpty():
        raise ValueError("same generation with other content")
    return differs.select("key", F.when(F.col("n").isNull(), "tombstone").otherwise("write").alias("op"))


def relate(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Typed edges (source, target, ...) both of whose ends are live records (id)."""
    for c in ("source", "target"):
        edges = edges.join(live.select(F.col("id").alias(c)), c, "left_semi")
    return edges


def best_per_document(pieces: DataFrame) -> DataFrame:
    """The best-scored piece per query and document: (query_id, doc, id, score)."""
    best = F.min(F.struct((-F.col("score")).alias("n"), "id"))
    return pieces.groupBy("query_id", "doc").agg(best.alias("b")).select("query_id", "doc", "b.id", (-F.col("b.n")).alias("score"))


TRANSITIONS = {("submitted", "approve"): "approved", ("submitted", "reject"): "rejected", ("approved", "apply"): "applied", ("applied", "rollback"): "rolled_back"}


def advance(queue: DataFrame, action: str) -> DataFrame:
    """Queue rows (id, state) after an action; rows it doesn't fit keep their state."""
    out = F.col("state")
    for (state, act), to in TRANSITIONS.items():
        if act == action:
            out = F.when(F.col("state") == state, to).otherwise(out)
    return queue.withColumn("state", out)


def flow_merge(rows: DataFrame, cap: int = 8) -> DataFrame:
    """Per (source, target): the union of semantics, least confidence, at most ``cap`` supports in
    order and how many were left out."""
    g = rows.groupBy("source", "target").agg(F.array_sort(F.collect_set("semantics")).alias("semantics"), F.min("confidence").alias("confidence"), F.countDistinct("support").alias("n"))
    w = Window.partitionBy("source", "target").orderBy("support")
    top = rows.select("source", "target", "support").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)
    kept = top.groupBy("source", "target").agg(F.array_sort(F.collect_list("support")).alias("supports"))
    return g.join(kept, ["source", "target"], "left").withColumn("dropped", F.greatest(F.col("n") - cap, F.lit(0))).drop("n")
