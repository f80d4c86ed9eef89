"""Full-text search, rank fusion, fuzzy names and redaction over text columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import stored
from spandrel.operators.nearnames import edit_neighbours, gram_neighbours

K1, B = 1.2, 0.75


def terms(c: Column | str) -> Column:
    """Words in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, len): the inverted index of ``docs`` (id, text). Null texts have no terms."""
    t = docs.where(F.col("text").isNotNull()).select("id", terms("text").alias("ts"))
    return t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def okapi(tf: Column, length: Column, df: Column, n: Column, avg_len: Column) -> Column:
    """What a term adds to the score of a text."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def bm25(index: DataFrame, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """(query_id, id, score, rank) of ``queries`` (query_id, term), Okapi BM25.

    Only postings of queried terms are joined with collection statistics, which are one row; score
    ties go to the smaller id. Rows without any queried term aren't listed. All others are, unranked,
    where ``k`` is None.
    """
    stats = index.select("id", "len").distinct().agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    q = queries.distinct()
    used = index.join(q.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    weight = okapi(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avg_len"))
    w = used.join(df, "term").join(F.broadcast(stats)).select("term", "id", weight.alias("w"))
    s = q.join(w, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return s if k is None else top_k(s, k)


def rarest_terms(index: DataFrame, ids: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, term): the ``n`` rarest terms of each chosen document."""
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    mine = index.join(ids.select("id").distinct(), "id", "left_semi").select("id", "term").join(df, "term")
    w = Window.partitionBy("id").orderBy("df", "term")
    return mine.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(F.col("id").alias("query_id"), "term")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query: score falling, id rising. Each partition of the input is cut to its
    own k best before anything is shuffled."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(lists: Iterable[DataFrame], k: int = 10, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank)."""
    all_ = None
    for x in lists:
        x = x.select("query_id", "id", (F.lit(1.0) / (c + F.col("rank"))).alias("s"))
        all_ = x if all_ is None else all_.unionByName(x)
    return top_k(all_.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score")), k)


def normal_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def fuzzy_candidates(names: DataFrame, probes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(probe, name, score) with trigram Jaccard at least ``threshold``, exactly; see
    :class:`nearnames.GramBlock`."""
    n = names.select(normal_name("name").alias("name")).where(F.col("name") != "").distinct()
    p = probes.select(normal_name("probe").alias("probe")).where(F.col("probe") != "").distinct()
    return gram_neighbours(p, n, threshold)


def name_suggest(nodes: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """(probe, symbol, name, tier, distance, rank): same name in another case (0), last segment of a
    qualified name (1), prefix (2), few edits (3); by tier, distance, name, symbol.

    Probes of more than 256 characters are refused: they have no rows. Tiers 0 to 2 are equi-joins of
    distinct names. Probes they leave with fewer than ``k`` symbols meet every name for the edit
    tier, whatever it begins with: a quarter of the probe's length in edits, at least one.
    """
    n = nodes.where(F.col("name").isNotNull()).select("symbol", "name").distinct()
    first = n.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("symbol"))).where(F.col("r") <= k)
    first = stored(first.select("name", "symbol"))  # no suggestion takes more of one name's symbols
    names = stored(first.groupBy("name").agg(F.count("*").alias("n")).select("name", F.lower("name").alias("folded"), "n"))
    p = stored(probes.select("probe").where(F.length("probe") <= 256).distinct().withColumn("f", F.lower("probe")))
    seg = F.element_at(F.split("f", r"[.:#/]+"), -1)
    zero = F.lit(0).alias("distance")
    t0 = p.join(names, F.col("f") == F.col("folded")).select("probe", "name", "n", F.lit(0).alias("tier"), zero)
    t1 = p.withColumn("s", seg).where(F.col("s") != F.col("f")).join(names, F.col("s") == F.col("folded")).select("probe", "name", "n", F.lit(1).alias("tier"), zero)
    size = F.length("folded")
    starts = names.where(size > 1).select("name", "n", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring(F.col("folded"), F.lit(1), i))).alias("f"))
    t2 = p.join(starts, "f").select("probe", "name", "n", F.lit(2).alias("tier"), (F.col("size") - F.length("f")).alias("distance"))
    found = t0.unionByName(t1).unionByName(t2).groupBy("probe", "name", "n").agg(F.min(F.struct("tier", "distance")).alias("m")).select("probe", "name", "n", "m.*")
    order = Window.partitionBy("probe").orderBy("tier", "distance", "name")
    found = stored(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"))
    has = found.groupBy("probe").agg(F.sum("n").alias("n"), F.count(F.when(F.col("tier") > 0, 1)).alias("other"))
    lacking = p.join(has, "probe", "left").withColumn("need", k - F.coalesce("n", F.lit(0))).where(F.col("need") > 0)
    # names of other tiers may be among the nearest, and count for nothing there
    lacking = lacking.select("probe", "f", F.greatest(F.lit(1), F.floor(F.length("f") / 4)).alias("most"), (F.col("need") + F.coalesce("other", F.lit(0))).alias("need"))
    # 256 characters and a quarter of them in edits
    t3 = edit_neighbours(lacking, names.where(size <= 320)).join(names, "folded").select("probe", "name", "n", F.lit(3).alias("tier"), "distance")
    best = found.unionByName(t3).groupBy("probe", "name").agg(F.min(F.struct("tier", "distance")).alias("m")).select("probe", "name", "m.*")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r").join(first, "name")
    w = Window.partitionBy("probe").orderBy("tier", "distance", "name", "symbol")
    return best.select("probe", "symbol", "name", "tier", "distance").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours (optimal string alignment)."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def osa(a: str, b: str) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(p, q) for p, q in zip(x, y)], dtype="int32")

    return F.pandas_udf(run, "int")(a, b)


def fnv1a(token: bytes) -> int:
    h = 0x811C9DC5
    for b in token:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def hash_embed(text: str | None, dim: int = 128) -> list[float]:
    """Counts of hashed tokens, normalised; zeros for no tokens."""
    v = [0.0] * dim
    for t in (text or "").split():
        v[fnv1a(t.encode()) % dim] += 1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def hash_embedding(c: str, dim: int = 128) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([hash_embed(x, dim) for x in s])

    return F.pandas_udf(run, "array<double>")(c)


def chunk_markdown(md: str | None, most_words: int = 800) -> list[str]:
    """Pieces of a text: cut at first and second level headings outside fences, lines packed up to
    ``most_words``; an over-long line is cut at words; empty pieces are dropped."""
    pieces: list[str] = []
    cur: list[str] = []
    n, fence = 0, False

    def flush() -> None:
        nonlocal n
        t = "\n".join(cur).strip()
        if t:
            pieces.append(t)
        cur.clear()
        n = 0

    for line in (md or "").splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        if not fence and re.match(r"#{1,2} ", line):
            flush()
        words = line.split()
        if n + len(words) > most_words:
            flush()
        while len(words) > most_words:
            pieces.append(" ".join(words[:most_words]))
            words = words[most_words:]
            line = " ".join(words)
        cur.append(line)
        n += len(words)
    flush()
    return pieces


def chunks(docs: DataFrame, most_words: int = 800) -> DataFrame:
    """(id, chunk, text) of ``docs`` (id, text)."""
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([chunk_markdown(x, most_words) for x in s])

    return docs.select("id", F.posexplode(F.pandas_udf(run, "array<string>")("text")).alias("chunk", "text"))
