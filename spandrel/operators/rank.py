"""Whole-graph analytics: PageRank, communities, vector clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spandrel.functions.lineage import broadcast_if_small, cut, discard, stored
from spandrel.operators.textsearch import top_k


def _links(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds) & (F.col("source") != F.col("target"))).select("source", "target")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 30, damping: float = 0.85, seeds: DataFrame | None = None, seed_weight: float = 100.0,
             kinds: Sequence[str] = ("calls", "imports"), epsilon: float = 1e-6) -> DataFrame:
    """(symbol, score) by power iteration until the L1 change is below ``epsilon``, at most
    ``iterations`` rounds; scores sum to 1. The first vector is uniform, with seeds too.

    Self-loops are dropped, parallel edges kept; edges to unknown nodes are ignored; what dangling
    nodes hold goes back through the teleport vector, which favours ``seeds`` if given.
    """
    spark = nodes.sparkSession
    ids = nodes.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    if seeds is None:
        w = ids.withColumn("w", F.lit(1.0))
    else:
        w = ids.join(seeds.select("symbol").distinct().withColumn("s", F.lit(True)), "symbol", "left").select("symbol", F.when(F.col("s"), seed_weight).otherwise(1.0).alias("w"))
    numbered = stored(w.withColumn("id", F.monotonically_increasing_id()))
    n, total = numbered.agg(F.count("*"), F.sum("w")).first()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    place = lambda c: broadcast_if_small(numbered.select(F.col("symbol").alias(c), F.col("id").alias(f"{c}_id")), n)
    links = _links(edges, kinds).join(place("source"), "source").join(place("target"), "target").select("source_id", "target_id")
    # laid out by source once, so that only shares and gains are shuffled in a round
    links = links.repartition("source_id").persist()
    out = links.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("out"))
    base = numbered.join(broadcast_if_small(out, n), "id", "left").select("id", (F.col("w") / total).alias("teleport"), "out", F.lit(1.0 / n).alias("rank"))
    held = F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("dangling")
    state = stored(base)
    dangling = state.agg(held).first()[0]
    for _ in range(iterations):
        share = state.where(F.col("out").isNotNull()).select(F.col("id").alias("source_id"), (F.col("rank") / F.col("out")).alias("share"))
        gained = links.join(broadcast_if_small(share, n), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum("share").alias("gain"))
        fresh = (1 - damping + damping * dangling) * F.col("teleport") + damping * F.coalesce("gain", F.lit(0.0))
        following = stored(state.join(broadcast_if_small(gained, n), "id", "left").select("id", "teleport", "out", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("change")))
        discard(state)
        state = following
        dangling, change = state.agg(held, F.sum("change")).first()
        if change < epsilon:
            break
    links.unpersist()
    return numbered.join(state, "id").select("symbol", F.col("rank").alias("score"))


def modularity(edges: DataFrame, assignment: DataFrame, gamma: float = 1.0, kinds: Sequence[str] = ("calls", "imports")) -> DataFrame:
    """One row (q): Newman-Girvan modularity of (symbol, community) over edges with both ends
    assigned; null without such edges."""
    a = assignment.select("symbol", "community")
    e = _links(edges, kinds).join(a.toDF("source", "cs"), "source").join(a.toDF("target", "ct"), "target")
    pairs = e.groupBy("cs", "ct").agg(F.count("*").alias("n"))  # all that is left to know, in one pass over the edges
    inside = F.when(F.col("cs") == F.col("ct"), F.col("n")).otherwise(0)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("cs").alias("c"), "n", inside.alias("l")), F.struct(F.col("ct").alias("c"), "n", F.lit(0).cast("bigint").alias("l")))).alias("x"))
    per = ends.groupBy("x.c").agg(F.sum("x.n").alias("d"), F.sum("x.l").alias("l"))
    t = per.agg(F.sum("l").alias("l"), F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"), (F.sum("d") / 2.0).alias("m"))
    return t.select((F.col("l") / F.col("m") - gamma * F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("q"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(symbol, component): the least symbol of each connected component, edges (source, target).

    Alternating large-star and small-star steps on the edge list, with numbers for symbols: the
    number of rounds grows with the logarithm of the graph, and stars keep hubs from being joined
    with themselves. A round is settled when it hands on the edges it was given; it raises if
    ``max_rounds`` don't suffice.
    """
    ends = edges.select("source", "target").where(F.col("source").isNotNull() & F.col("target").isNotNull())
    names = stored(ends.select(F.explode(F.array("source", "target")).alias("symbol")).distinct().withColumn("id", F.monotonically_increasing_id()))
    n = names.count()
    place = lambda c: broadcast_if_small(names.select(F.col("symbol").alias(c), F.col("id").alias(f"{c}_id")), n)
    e = ends.join(place("source"), "source").join(place("target"), "target").select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v"))
    e = stored(e.where(F.col("u") != F.col("v")).distinct())
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        following = stored(small)
        discard(e)
        e = following
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())  # a fingerprint of the edges
        if now == last or not now[0]:
            break
        last = now
    else:
        raise RuntimeError(f"components still grow after {max_rounds} rounds")
    root = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("r"))
    member = names.join(broadcast_if_small(root, n), "id", "left").select("symbol", F.coalesce("r", "id").alias("r"))
    least = member.groupBy("r").agg(F.min("symbol").alias("component"))
    return member.join(least, "r").select("symbol", "component")


#: Levels of at most so many links (each in both directions) settle on the driver, node by node: 24 bytes
#: a link come in, and two copies of them are held.
FEW_LINKS = 3_000_000


def _weights(edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    """(names, w, n): numbers of the linked symbols (symbol, id), n of them and in their order, and
    links (a, b, w) in both directions between numbers."""
    l = _links(edges, kinds)
    ends = l.select(F.explode(F.array("source", "target")).alias("symbol")).distinct()
    names = stored(ends.orderBy("symbol").select("symbol", F.monotonically_increasing_id().alias("id")))
    n = names.count()
    place = lambda c, to: broadcast_if_small(names.select(F.col("symbol").alias(c), F.col("id").alias(to)), n)
    l = l.join(place("source", "a"), "source").join(place("target", "b"), "target").groupBy("a", "b").agg(F.count("*").alias("w"))
    w = l.unionByName(l.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").cast("double").alias("w"))
    return names, stored(w), n


def _named(nodes: DataFrame, names: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """(symbol, community) of all nodes from numbers (id, c); nodes without links are alone."""
    label = broadcast_if_small(names.select(F.col("symbol").alias("community"), F.col("id").alias("c")), n)
    j = names.join(broadcast_if_small(of, n), "id").join(label, "c").select("symbol", "community")
    return nodes.select("symbol").distinct().join(broadcast_if_small(j, n), "symbol", "left").select("symbol", F.coalesce("community", "symbol").alias("community"))


def _arrays(w: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, to, weight): the links of ``w`` laid out by node, on the driver."""
    t = w.toArrow()
    a, b, x = (t.column(c).to_numpy() for c in ("a", "b", "w"))
    ids, a = np.unique(a, return_inverse=True)
    b = np.searchsorted(ids, b)
    return ids, *_laid_out(a, b, x, len(ids))


def _laid_out(a: np.ndarray, b: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(a * n + b)
    return np.searchsorted(a[order], np.arange(n + 1)), b[order], x[order]


def _settled_in_order(start: np.ndarray, to: np.ndarray, weight: np.ndarray, two_m: float, gamma: float) -> tuple[np.ndarray, int]:
    """As :func:`_settled`, by sequential moves in the order of numbers, on links laid out by node.

    Nodes none of whose neighbours moved are passed over; with ``gamma`` other nodes' moves count
    too, so that all are looked at again before it ends.
    """
    n = len(start) - 1
    k = np.add.reduceat(weight, start[:-1]).tolist() if n else []
    at, c, total, moves = start.tolist(), list(range(n)), list(k), 0
    stale, whole, moved = bytearray(b"\1") * n, True, True
    while moved or not whole:
        whole = not moved
        if whole and gamma:
            stale = bytearray(b"\1") * n
        moved = False
        a = stale.find(1)
        while a >= 0:
            stale[a] = 0
            near = to[at[a] : at[a + 1]].tolist()
            inner: dict = {}
            for b, x in zip(near, weight[at[a] : at[a + 1]].tolist()):
                if b != a:
                    inner[c[b]] = inner.get(c[b], 0.0) + x
            now = best = c[a]
            total[now] -= k[a]
            most = inner.get(now, 0.0) - gamma * k[a] * total[now] / two_m
            for d in sorted(inner):
                gain = inner[d] - gamma * k[a] * total[d] / two_m
                if d != now and gain > most + 1e-12:
                    most, best = gain, d
            total[best] += k[a]
            if best != now:
                c[a], moved, moves = best, True, moves + 1
                for b in near:
                    if b != a:
                        stale[b] = 1
            a = stale.find(1, a + 1)
    return np.array(c, np.int64), moves


def _levels_in_order(w: DataFrame, two_m: float, gamma: float, levels: int) -> DataFrame:
    """(id, c) after all levels of moving and merging, on the driver."""
    ids, start, to, weight = _arrays(w)
    of, first = np.arange(len(ids)), ids
    for _ in range(levels):
        c, moves = _settled_in_order(start, to, weight, two_m, gamma)
        if not moves:
            return w.sparkSession.createDataFrame(pa.table({"id": ids, "c": first[of]}))
        kept, c = np.unique(c, return_inverse=True)
        of, first, n = c[of], first[kept], len(kept)
        link, place = np.unique(np.repeat(c, np.diff(start)) * n + c[to], return_inverse=True)
        start, to, weight = _laid_out(*np.divmod(link, n), np.bincount(place, weight), n)
    raise RuntimeError("communities still merge after the last level")


def _settled(w: DataFrame, two_m: float, gamma: float, rounds: int) -> tuple[DataFrame, int]:
    """((a, k, c), moves): the nodes of ``w`` (a, b, w), each first alone, moved to neighbouring
    communities until none gains from a move. Gain is the weight to a community's nodes less
    ``gamma`` times degree times its total degree over ``two_m``.

    In each round a coin per community decides whether nodes may leave or join it, so what a mover
    counts on stays; where many join or leave one community, those of greatest gain go first and
    each must still gain after them. The sum over all nodes so grows in every round with a move, and
    the loop ends; ``rounds`` is a safeguard that raises. Ties go to the least community.
    """
    spark = w.sparkSession
    state = stored(w.groupBy("a").agg(F.sum("w").alias("k")).select("a", "k", F.col("a").alias("c")))
    # laid out by neighbour once, so that only communities and their weights are shuffled in a round
    links = stored(w.where(F.col("a") != F.col("b")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b").sortWithinPartitions("b"))
    moves = 0
    for i in range(rounds):
        total = state.groupBy("c").agg(F.sum("k").alias("t"))
        near = links.join(state.select(F.col("a").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("w").alias("inner"))
        own = state.join(total, "c").select("a", "k", F.col("c").alias("now"), (-gamma * F.col("k") * (F.col("t") - F.col("k")) / two_m).alias("alone"))
        offer = near.join(own, "a").join(total, "c")
        here = F.col("c") == F.col("now")
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(i)), F.lit(2))
        value = F.col("inner") - gamma * F.col("k") * F.col("t") / two_m
        best = offer.groupBy("a", "k", "now", "alone").agg(
            F.coalesce(F.max(F.when(here, F.col("inner"))), F.lit(0.0)).alias("held"), F.max(F.when(~here, value)).alias("most"),
            F.min(F.when(~here & (coin("now") == 0) & (coin("c") == 1), F.struct((-value).alias("n"), "c"))).alias("x"))
        stay = F.col("held") + F.col("alone")
        best = stored(best.where(F.col("most") > stay + 1e-12).select("a", "k", "now", F.col("x.c").alias("c"), (-F.col("x.n") - stay).alias("gain")))
        if best.isEmpty():
            return state, moves
        go = best.where(F.col("c").isNotNull() & (F.col("gain") > 1e-12))
        if gamma:
            before = lambda c: F.coalesce(F.sum("k").over(Window.partitionBy(c).orderBy(F.desc("gain"), "a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            go = go.withColumn("j", before("c")).withColumn("l", before("now")).where(F.col("gain") - gamma * F.col("k") * (F.col("j") + F.col("l")) / two_m > 1e-12)
        go = stored(go.select("a", F.col("c").alias("to")))
        moved = go.count()
        if moved:
            moves += moved
            state = stored(state.join(go, "a", "left").select("a", "k", F.coalesce("to", "c").alias("c")))
    raise RuntimeError(f"nodes still move after {rounds} rounds")


#: Levels of at most so many links (each in both directions) settle on the driver by rounds over whole
#: arrays: 4 bytes a link and 12 while they are laid out; 12 and 36 where weights differ.
MANY_LINKS = 20_000_000
#: Links that are looked at together there.
LINK_BLOCK = 2_000_000


def _hashed(edges: DataFrame, kinds: Sequence[str]) -> tuple[DataFrame, DataFrame, int] | None:
    """(names, pairs, n): the linked symbols (symbol, id, h), n of them, with numbers in their order
    and hashes, and links (a, b, w) in one direction between hashes; None where two symbols share one."""
    l = _links(edges, kinds)
    ends = l.select(F.explode(F.array("source", "target")).alias("symbol")).distinct()
    names = stored(ends.select("symbol", F.xxhash64("symbol").alias("h")))
    n, hashes = names.agg(F.count("*"), F.count_distinct("h")).first()
    if hashes < n:
        return None
    a, b = F.xxhash64("source"), F.xxhash64("target")
    pairs = stored(l.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("w")))
    return stored(names.orderBy("symbol").select("symbol", F.monotonically_increasing_id().alias("id"), "h")), pairs, n


def _pair_arrays(names: DataFrame, pairs: DataFrame, count: int, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(ids, start, to, weight): links in both directions between places in ids, laid out by node, on
    the driver, where the ``count`` pairs come in by parts; no weight where they are ``alike``, all 1."""
    t = names.select("id", "h").toArrow()
    ids, h = (t.column(c).to_numpy() for c in ("id", "h"))
    order = np.argsort(ids)
    ids, h = ids[order], h[order]
    by = np.argsort(h)
    h, bits = h[by], len(ids).bit_length()
    key, weight, at = np.empty(2 * count, np.int64), None if alike else np.empty(2 * count), 0
    parts = -(-count // LINK_BLOCK)
    for part in range(parts):
        t = pairs.where(F.pmod("a", F.lit(parts)) == part).toArrow()
        a, b = (by[np.searchsorted(h, t.column(c).to_numpy())] for c in ("a", "b"))
        for x, y in ((a, b), (b, a)):
            key[at : at + len(a)] = x << bits | y
            if weight is not None:
                weight[at : at + len(a)] = t.column("w").to_numpy()
            at += len(a)
    return ids, *_unpacked(key, weight, len(ids))


def _unpacked(key: np.ndarray, weight: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(start, to, weight) of links packed as numbers, from node and to node."""
    bits = n.bit_length()
    if weight is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        del order
    to = np.empty(len(key), np.int32)
    for lo in range(0, len(key), LINK_BLOCK):
        to[lo : lo + LINK_BLOCK] = key[lo : lo + LINK_BLOCK] & ((1 << bits) - 1)
    return np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << bits), to, weight


def _places(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(degrees, places): where the links of the nodes ``at`` are, one node after the other."""
    degree = start[at + 1] - start[at]
    before = np.cumsum(degree) - degree
    return degree, np.repeat(start[at] - before, degree) + np.arange(degree.sum())


def _firsts(x: np.ndarray) -> np.ndarray:
    """Places in a sorted array where its value isn't the one before."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _ahead(group: np.ndarray, gain: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The weight of those of greater gain in one's group; at the same gain those before count."""
    order = np.lexsort((-gain, group))
    sums = np.cumsum(k[order]) - k[order]
    first = _firsts(group[order])
    out = np.empty(len(k))
    out[order] = sums - np.repeat(sums[first], np.diff(np.append(first, len(k))))
    return out


def _coins(n: int, i: int) -> np.ndarray:
    """Tossed for n communities in round i."""
    x = np.arange(n, dtype=np.uint64) + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x ^ x >> np.uint64(31)) & np.uint64(1) == 1


def _settled_at_once(start: np.ndarray, to: np.ndarray, weight: np.ndarray | None, k: np.ndarray, two_m: float, gamma: float, rounds: int) -> tuple[np.ndarray, int]:
    """As :func:`_settled`, on links laid out by node, without those of a node to itself; ``k`` are
    degrees. Blocks of nodes are looked at together, each after the moves of the one before; nodes
    none of whose neighbours moved are passed over until all others are settled."""
    n, g = len(k), gamma / two_m
    bits = n.bit_length()
    c, total, moves = np.arange(n, dtype=np.int32), k.copy(), 0
    stale, whole = np.ones(n, bool), True
    for i in range(rounds):
        if not stale.any():
            if whole or not gamma:
                return c, moves
            stale[:], whole = True, True
        coin = _coins(n, i)
        turn = np.flatnonzero(stale & ~coin[c])
        stale[turn] = False
        for at in _blocks(start, turn):
            degree, place = _places(start, at)
            key = np.repeat(np.arange(len(at)) << bits, degree) | c[to[place]]
            key, inner = _summed(key, None if weight is None else weight[place])
            row, d = key >> bits, key & ((1 << bits) - 1)
            now, own = c[at], k[at]
            here = d == now[row]
            stay = -g * own * (total[now] - own)
            stay[row[here]] += inner[here]
            gain = inner - g * own[row] * total[d] - stay[row]
            offer = np.flatnonzero((gain > 1e-12) & ~here)
            if not len(offer):
                continue
            stale[at[row[offer]]] = True
            offer = offer[coin[d[offer]]]
            row, d, gain = row[offer], d[offer], gain[offer]
            if not len(offer):
                continue
            first = _firsts(row)
            most = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(row)))))
            best = most[_firsts(row[most])]  # of the least community
            row, d, gain = row[best], d[best], gain[best]
            go = gain - g * own[row] * (_ahead(d, gain, own[row]) + _ahead(now[row], gain, own[row])) > 1e-12 if gamma else np.ones(len(row), bool)
            row, d = row[go], d[go]
            mover = at[row]
            np.subtract.at(total, c[mover], own[row])
            np.add.at(total, d, own[row])
            c[mover] = d
            stale[to[_places(start, mover)[1]]] = True
            moves, whole = moves + len(row), False
    raise RuntimeError(f"nodes still move after {rounds} rounds")


def _summed(key: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, in order, and what each weighs."""
    if weight is None:
        key = np.sort(key)
        first = _firsts(key)
        return key[first], np.diff(np.append(first, len(key))).astype(np.float64)
    order = np.argsort(key)
    key = key[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(weight[order], first) if len(key) else np.zeros(0)


def _blocks(start: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The nodes ``at`` in blocks of some LINK_BLOCK links; a node's links aren't parted."""
    return np.split(at, _firsts(np.cumsum(start[at + 1] - start[at]) // LINK_BLOCK)[1:])


def _merged(start: np.ndarray, to: np.ndarray, weight: np.ndarray | None, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links between n communities, without those within one."""
    bits, parts = n.bit_length(), [(np.zeros(0, np.int64), np.zeros(0))]
    for at in _blocks(start, np.argsort(c, kind="stable")):  # most links of two communities meet in one block
        degree, place = _places(start, at)
        own, other = np.repeat(c[at], degree), c[to[place]]
        across = own != other
        parts.append(_summed(own[across].astype(np.int64) << bits | other[across], None if weight is None else weight[place[across]]))
    return _unpacked(*_summed(*(np.concatenate(x) for x in zip(*parts))), n)


def _levels_at_once(start: np.ndarray, to: np.ndarray, weight: np.ndarray | None, k: np.ndarray, two_m: float, gamma: float, rounds: int, levels: int) -> np.ndarray:
    """The community of every node after all levels of moving and merging, named by the node it began with."""
    of, first = np.arange(len(k), dtype=np.int32), np.arange(len(k), dtype=np.int32)
    for _ in range(levels):
        c, moves = _settled_at_once(start, to, weight, k, two_m, gamma, rounds)
        if not moves:
            return first[of]
        kept, c = np.unique(c, return_inverse=True)
        c, n = c.astype(np.int32), len(kept)
        of, first, k = c[of], first[kept], np.bincount(c, k, n)
        start, to, weight = _merged(start, to, weight, c, n)
    raise RuntimeError("communities still merge after the last level")


def _levels_of(w: DataFrame, two_m: float, gamma: float, rounds: int, levels: int) -> DataFrame:
    """(id, c) after :func:`_levels_at_once` on links (a, b, w) in both directions."""
    ids, start, to, weight = _arrays(w)
    k = np.add.reduceat(weight, start[:-1])
    start, to, weight = _merged(start, to, weight, np.arange(len(ids), dtype=np.int32), len(ids))
    c = _levels_at_once(start, to, weight, k, two_m, gamma, rounds, levels)
    return w.sparkSession.createDataFrame(pa.table({"id": ids, "c": ids[c]}))


def label_communities(nodes: DataFrame, edges: DataFrame, rounds: int = 1_000, kinds: Sequence[str] = ("calls", "imports"), few: int = FEW_LINKS) -> DataFrame:
    """(symbol, community) by label propagation, run until no node has a label that more of its
    neighbours bear than its own (ties: its own, then the least label).

    The distributed stand-in for sequential local moving; see :func:`_settled`. It raises where
    ``rounds`` don't suffice.
    """
    names, w, n = _weights(edges, kinds)
    if w.count() <= few:
        ids, start, to, weight = _arrays(w)
        c, _ = _settled_in_order(start, to, weight, 1.0, 0.0)
        of = w.sparkSession.createDataFrame(pa.table({"id": ids, "c": ids[c]}))
    else:
        state, _ = _settled(w, 1.0, 0.0, rounds)
        of = state.select(F.col("a").alias("id"), "c")
    return _named(nodes, names, of, n)


def cosine(a, b):
    """Cosine of two array columns; 0 where a norm is 0 or lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot / n).otherwise(F.lit(0.0))


QUERY_BLOCK = 4_096


def vector_nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): exact cosine neighbours of every query among all vectors.

    ``vectors`` (id, v), ``queries`` (query_id, v). Queries go out in blocks of at most 4 096 (a
    bounded broadcast each); every partition multiplies its rows with the block and keeps its k
    best, so what is shuffled is k rows per query and partition. Zero or mismatching vectors are
    skipped; ties go to the smaller id; a query's own id counts as a neighbour.
    """
    q = queries.where(F.col("v").isNotNull() & F.col("query_id").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields} | {"id": vectors.schema["id"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    buckets = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    for b in range(buckets):
        block = q.where(F.pmod(F.xxhash64("query_id"), F.lit(buckets)) == b).select("query_id", "v").toPandas()
        if block.empty:
            continue
        part = vectors.select("id", "v").where(F.col("v").isNotNull()).mapInPandas(_nearest_in(block, k), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema + ", rank int")
    return top_k(out, k).select("query_id", "id", "score", "rank")


def _nearest_in(block: pd.DataFrame, k: int):
    """Neighbours for a block of queries, the k best of a partition; only vectors of a query's own
    length are compared."""
    groups = {}
    for dim, good in block.groupby(block["v"].map(len)):
        qm = np.array(good["v"].tolist(), np.float64).reshape(len(good), dim)
        qn = np.linalg.norm(qm, axis=1)
        if (qn > 0).any():
            groups[dim] = qm[qn > 0] / qn[qn > 0, None], good["query_id"].to_numpy()[qn > 0]

    def best(s, own):
        order = np.lexsort((own, -s), axis=1)[:, :k]
        return np.take_along_axis(s, order, 1), np.take_along_axis(own, order, 1)

    def run(frames):
        kept = {}
        for whole in frames:
            for dim, (qm, _) in groups.items():
                f = whole[[len(v) == dim for v in whole["v"]]]
                if f.empty:
                    continue
                m = np.array(f["v"].tolist(), np.float64)
                n = np.linalg.norm(m, axis=1)
                if not (n > 0).any():
                    continue
                s = np.round(qm @ (m[n > 0] / n[n > 0, None]).T, 12)
                own = np.broadcast_to(f["id"].to_numpy()[n > 0], s.shape)
                if dim in kept:
                    s, own = np.hstack((kept[dim][0], s)), np.hstack((kept[dim][1], own))
                kept[dim] = best(s, own)
        for dim, (s, own) in kept.items():
            yield pd.DataFrame({"query_id": np.repeat(groups[dim][1], s.shape[1]), "id": own.ravel(), "score": s.ravel()})

    return run


def kmeans_cosine(vectors: DataFrame, k: int = 16, iterations: int = 10) -> DataFrame:
    """(id, cluster): farthest-point seeding from the least id, then Lloyd steps in cosine space.

    Centroids (k vectors) are the only thing on the driver; assignment and sums are distributed. An
    empty cluster keeps its centroid. Ties go to the first cluster.
    """
    v = cut(vectors.where(F.col("v").isNotNull()).select("id", F.transform("v", lambda x: x.cast("double")).alias("v")))
    first = v.orderBy("id").limit(1).collect()
    if not first:
        return v.select("id", F.lit(None).cast("int").alias("cluster"))
    cents = [list(first[0].v)]

    def scores(cs):
        m = np.array(cs, np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

        def f(s: pd.Series) -> pd.DataFrame:
            x = np.array(s.tolist(), np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            d = np.round(x @ m.T, 12)
            return pd.DataFrame({"c": d.argmax(axis=1), "s": d.max(axis=1)})

        return F.pandas_udf(f, "c int, s double")

    while len(cents) < k:
        far = v.withColumn("n", scores(cents)("v")).orderBy("n.s", "id").limit(1).collect()[0]
        if far.n.s >= 1 - 1e-12:
            break
        cents.append(list(far.v))
    for _ in range(iterations):
        a = v.withColumn("n", scores(cents)("v")).select(F.col("n.c").alias("c"), F.posexplode("v").alias("p", "x"))
        sums = a.groupBy("c", "p").agg(F.avg("x").alias("x")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("v"))
        fresh = {r.c: list(r.v) for r in sums.collect()}  # at most k rows
        moved = [fresh.get(i, c) for i, c in enumerate(cents)]
        if np.allclose(moved, cents, atol=1e-12):
            break
        cents = moved
    return v.select("id", scores(cents)("v")["c"].alias("cluster"))


def dbscan_cosine(vectors: DataFrame, eps: float = 0.25, min_points: int = 3, most: int = 500_000) -> DataFrame:
    """(id, cluster): density clusters by cosine distance, named by their least core id; noise is
    left out; a border point joins the least cluster among its core neighbours.

    Neighbour pairs come from :func:`range_pairs`, which multiplies blocks: work grows with the
    square of the number of vectors, so more than ``most`` are refused. Core points are joined into
    components by their links.
    """
    if vectors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors")
    pairs = cut(range_pairs(vectors, 1 - eps))
    count = pairs.groupBy("a").agg(F.count("*").alias("n"))
    core = cut(count.where(F.col("n") >= min_points).select(F.col("a").alias("id")))
    linked = pairs.join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("target"))
    comp = cut(connected_components(linked).toDF("id", "cluster"))
    border = pairs.join(core.toDF("a"), "a", "left_anti").join(comp.toDF("b", "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    return comp.unionByName(border)


BLOCK = 2_048


def range_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b) with cosine at least ``least``, both orders and each with itself: one block of at
    most 2 048 vectors at a time against all rows. For the clustering of bounded sets."""
    v = vectors.select("id", "v").where(F.col("v").isNotNull())
    kind = vectors.schema["id"].dataType.simpleString()
    blocks = max(1, -(-v.count() // BLOCK))
    out = None
    for b in range(blocks):
        block = v.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if block.empty:
            continue
        m = np.array(block["v"].tolist(), np.float64)
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids = block["id"].to_numpy()

        def run(frames, m=m, ids=ids):
            for f in frames:
                x = np.array(f["v"].tolist(), np.float64)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                r, c = np.nonzero(np.round(x @ m.T, 9) >= round(least, 9))
                yield pd.DataFrame({"a": f["id"].to_numpy()[r], "b": ids[c]})

        part = v.mapInPandas(run, f"a {kind}, b {kind}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}")


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 1_000, levels: int = 50, gamma: float = 1.0, kinds: Sequence[str] = ("calls", "imports"), few: int = FEW_LINKS // 10,
            many: int = MANY_LINKS) -> DataFrame:
    """(symbol, community) by local moving and aggregation.

    Nodes move by :func:`_settled` until none gains in modularity; then communities become nodes of
    the next level, until a level merges nothing. ``rounds`` a level and ``levels`` are safeguards
    that raise. Levels of more than ``many`` links are joins and aggregates: no component of them is
    gathered; the first that is smaller and all after it settle on the driver, by rounds over arrays
    or, if it has at most ``few`` links, in the order of ids.
    """
    if (hashed := _hashed(edges, kinds)) is None:
        names, w, n = _weights(edges, kinds)
        links, two_m = w.agg(F.count("*"), F.sum("w")).first()
    else:
        names, pairs, n = hashed
        count, weight, most = pairs.agg(F.count("*"), F.sum("w"), F.max("w")).first()
        links, two_m = 2 * count, 2.0 * (weight or 0)
        if few < links <= many:
            ids, *laid = _pair_arrays(names, pairs, count, most == 1)
            k = np.diff(laid[0]).astype(np.float64) if laid[2] is None else np.add.reduceat(laid[2], laid[0][:-1])
            c = _levels_at_once(*laid, k, two_m, gamma, rounds, levels)
            return _named(nodes, names, edges.sparkSession.createDataFrame(pa.table({"id": ids, "c": ids[c]})), n)
        place = lambda c: broadcast_if_small(names.select(F.col("h").alias(c), F.col("id").alias(f"{c}_id")), n)
        l = pairs.join(place("a"), "a").join(place("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("w").cast("double").alias("w"))
        w = stored(l.unionByName(l.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    of = names.select("id", F.col("id").alias("c"))
    for level in range(levels):
        if links <= max(few, many):
            rest = (_levels_in_order(w, two_m, gamma, levels - level) if links <= few else _levels_of(w, two_m, gamma, rounds, levels - level)) if links else of
            if level:
                rest = of.join(rest.toDF("c", "d"), "c").select("id", F.col("d").alias("c"))
            return _named(nodes, names, rest, n)
        state, moves = _settled(w, two_m, gamma, rounds)
        if not moves:
            return _named(nodes, names, of, n)
        merged = state.select("a", "c")
        of = stored(of.join(merged.toDF("c", "d"), "c").select("id", F.col("d").alias("c")))
        w = stored(w.join(merged, "a").join(merged.toDF("b", "d"), "b").groupBy(F.col("c").alias("a"), F.col("d").alias("b")).agg(F.sum("w").alias("w")))
        links = w.count()
    raise RuntimeError(f"communities still merge after {levels} levels")


def community_summary(assignment: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """(community, size, files): the size and the ``top`` files of each community by members."""
    j = assignment.join(nodes.select("symbol", "file"), "symbol", "left")
    per = j.groupBy("community", "file").agg(F.count("*").alias("n"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), "file")
    files = per.withColumn("r", F.row_number().over(w)).groupBy("community").agg(F.sum("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "file")))), lambda x: x["file"]).alias("files"))
    return files


def singleton_rate(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row (rate): the share of nodes in no community of two members or more; null without nodes."""
    big = assignment.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("community")
    covered = assignment.join(big, "community", "left_semi").select("symbol").distinct().withColumn("c", F.lit(True))
    return nodes.select("symbol").distinct().join(covered, "symbol", "left").agg(F.round(F.count(F.when(F.col("c").isNull(), 1)) / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"))


def package_ring(nodes: DataFrame, weight: float) -> DataFrame:
    """(source, target, weight): edges that tie the nodes (symbol, directory) of a directory into a
    ring, in the order of symbols; a directory of one node has none."""
    w = Window.partitionBy("directory").orderBy("symbol")
    whole = Window.partitionBy("directory")
    r = nodes.where(F.col("symbol").isNotNull()).select("symbol", "directory").distinct()
    r = r.select("symbol", F.coalesce(F.lead("symbol").over(w), F.min("symbol").over(whole)).alias("target"), F.count("*").over(whole).alias("n"))
    return r.where(F.col("n") > 1).select(F.col("symbol").alias("source"), "target", F.lit(weight).alias("weight"))


def community_report(assignment: DataFrame, edges: DataFrame, ranks: DataFrame, top: int = 5, kinds: Sequence[str] = ("calls", "imports")) -> DataFrame:
    """(community, size, top, term): members, the ``top`` best-ranked of them in order, and what the
    community adds to the modularity of the whole."""
    a = assignment.select("symbol", "community")
    e = _links(edges, kinds).join(a.toDF("source", "cs"), "source").join(a.toDF("target", "ct"), "target")
    pairs = stored(e.groupBy("cs", "ct").agg(F.count("*").alias("n")))
    m = pairs.agg(F.sum("n")).first()[0] or 0
    ends = pairs.select(F.explode(F.array(F.struct(F.col("cs").alias("community"), "n", F.when(F.col("cs") == F.col("ct"), F.col("n")).otherwise(0).alias("l")), F.struct(F.col("ct").alias("community"), "n", F.lit(0).cast("bigint").alias("l")))).alias("x"))
    per = ends.groupBy("x.community").agg(F.sum("x.n").alias("d"), F.sum("x.l").alias("l"))
    size = a.groupBy("community").agg(F.count("*").alias("size"))
    best = top_k(a.join(ranks.select("symbol", "score"), "symbol").select(F.col("community").alias("query_id"), F.col("symbol").alias("id"), "score"), top)
    best = best.groupBy(F.col("query_id").alias("community")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("top"))
    share = F.coalesce("d", F.lit(0)) / (2.0 * m) if m else F.lit(0.0)
    term = F.coalesce("l", F.lit(0)) / F.lit(float(m)) - share * share if m else F.lit(None).cast("double")
    return size.join(per, "community", "left").join(best, "community", "left").select("community", "size", "top", term.alias("term"))
