"""Near-duplicate embeddings by a forest of random-projection trees with overlapping splits."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlog.llm.common import connected, if_small, pinned, slots, small_batches
from arborlog.llm.simhash import spanning

TREES = 6
#: Vectors of a leaf that are compared by one task; a larger leaf that can't be split is cut into pairs of such pieces.
LEAF = 1024
#: Half the width of the band around a split that goes to both sides, as a share of what two linked vectors' projections differ by as a
#: rule: their distance over the root of the dimension. Projections of all vectors spread with the same root, so a band
#: takes the same share of them, a tenth, in any dimension.
BAND = 0.6
#: About so many vectors of a node are looked at to split it; levels that one round adds.
SAMPLE, DEPTH = 512, 6
#: A split must leave both sides at most this share of the node, band included.
SHARE = 0.8
ROUNDS = 12


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision, also for very large and very small numbers."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def band(dimension: int, least: float) -> float:
    """Half the width of a split's band: vectors of cosine ``least`` are sqrt(2 - 2 least) apart, and their projections
    on a random direction about that over the root of the dimension."""
    return BAND * (2 - 2 * least) ** 0.5 / max(1, dimension) ** 0.5


def split(sample: np.ndarray, rng: np.random.Generator, depth: int, least: int, width: float):
    """A subtree over unit vectors: None for a leaf, else (direction, threshold, left, right).

    Of four random directions the one with the narrowest overlap is taken, cut at the median.
    """
    if depth == 0 or len(sample) <= max(16, least):
        return None
    best = None
    for _ in range(4):
        d = rng.standard_normal(sample.shape[1])
        d /= np.linalg.norm(d)
        p = sample @ d
        cut = float(np.median(p))
        share = max((p <= cut + width).mean(), (p >= cut - width).mean())
        if best is None or share < best[0]:
            best = share, d, cut, p
    share, d, cut, p = best
    if share > SHARE:
        return None
    return d, cut, split(sample[p <= cut + width], rng, depth - 1, least, width), split(sample[p >= cut - width], rng, depth - 1, least, width)


def leaves(tree, x: np.ndarray, rows: np.ndarray, width: float, path: int = 1):
    """(path, rows) of each leaf that rows reach; rows in the band of a split reach both sides."""
    if tree is None:
        yield path, rows
        return
    d, cut, left, right = tree
    p = x[rows] @ d
    yield from leaves(left, x, rows[p <= cut + width], width, 2 * path)
    yield from leaves(right, x, rows[p >= cut - width], width, 2 * path + 1)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _forest(distinct: DataFrame, trees: int, leaf: int, least: float) -> DataFrame:
    """distinct(rid, label, size, vec) -> pinned (rid, node long, vec): every leaf that each vector is in.

    A round splits each node of more than ``leaf`` vectors by a subtree fitted on a bounded sample of it.
    A node that no direction divides (a dense cluster) stays as it is.
    """
    kind = distinct.schema["vec"].dataType.simpleString()
    start = F.xxhash64(F.lit("tree"), "label", F.size("vec"), "t")
    state = pinned(distinct.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("rid", start.alias("node"), "vec", F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        large = pinned(state.where("not done").groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > leaf))
        if large.isEmpty():
            break
        seen = state.where("not done").join(if_small(large), "node").where(F.pmod(F.xxhash64("rid", "node"), F.lit(1 << 30)) < (F.lit(float(SAMPLE << 30)) / F.col("n")))

        def grow(key, pdf):
            x, n = unit(np.stack(pdf.sort_values("rid")["vec"].to_numpy())), int(pdf["n"].iloc[0])
            tree = split(x, np.random.Generator(np.random.PCG64(key[0] & (2**63 - 1))), DEPTH, len(x) * leaf // n, band(x.shape[1], least))
            return pd.DataFrame({"node": [key[0]], "tree": [pickle.dumps(tree)]})

        grown = pinned(seen.select("node", "rid", "vec", "n").groupBy("node").applyInPandas(grow, "node long, tree binary"))

        def route(batches):
            for b in batches:
                rid, node, vec, done, tree = (b.column(i) for i in range(5))
                out, closed, row = [], [], []
                nodes, at = node.to_numpy(), {}
                for i in range(b.num_rows):
                    at.setdefault((nodes[i], tree[i].is_valid), []).append(i)
                for (own, has), rows in at.items():
                    rows = np.array(rows)
                    t = pickle.loads(tree[int(rows[0])].as_py()) if has else None
                    if t is None:
                        out.append(np.full(len(rows), own)), closed.append(np.full(len(rows), True)), row.append(rows)
                        continue
                    x = unit(_vectors(vec.take(pa.array(rows))))
                    for path, hit in leaves(t, x, np.arange(len(rows)), band(x.shape[1], least)):
                        mixed = (int(own) * 0x9E3779B97F4A7C15 + path * 0xBF58476D1CE4E5B9) & (2**64 - 1)
                        mixed ^= mixed >> 31
                        out.append(np.full(len(hit), np.uint64(mixed).view(np.int64))), closed.append(np.full(len(hit), False)), row.append(rows[hit])
                take = pa.array(np.concatenate(row)) if row else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([rid.take(take), pa.array(np.concatenate(out) if out else [], pa.int64()), vec.take(take), pa.array(np.concatenate(closed) if closed else [], pa.bool_())], ["rid", "node", "vec", "done"])

        open_ = state.where("not done").join(if_small(grown), "node", "left").select("rid", "node", "vec", "done", "tree")
        state = pinned(state.where("done").unionByName(open_.mapInArrow(route, f"rid long, node long, vec {kind}, done boolean")))
    return state.select("rid", "node", "vec")


def _compared(side: np.ndarray, rid: np.ndarray, copies: np.ndarray, x: np.ndarray, inside: np.ndarray, node: int, least: float):
    """Links of one task: for each row the copies linked to it, and a root that it is connected with.

    A pair counts in one task only: that of the smallest node that both are in.
    """
    n = len(rid)
    links, near = np.zeros(n, dtype=np.int64), np.zeros((n, n), dtype=bool)
    for k in range(0, n, 256):
        hit = x[k : k + 256] @ x.T >= least
        hit[np.arange(len(hit)), np.arange(k, k + len(hit))] = False
        if side[0]:
            hit &= side[k : k + 256, None] != side[None, :]
        near[k : k + 256] = hit
        a, b = np.nonzero(hit)
        for s in range(0, len(a), 1 << 16):
            i, j = a[s : s + (1 << 16)] + k, b[s : s + (1 << 16)]
            both = (inside[i][:, :, None] == inside[j][:, None, :]) & (inside[i] != 0)[:, :, None]
            first = np.where(both.any(axis=2), inside[i], np.iinfo(np.int64).max).min(axis=1) == node
            links += np.bincount(i[first], weights=copies[j[first]], minlength=n).astype(np.int64)
    near |= near.T
    return links, spanning(near)


def near_embeddings(table: DataFrame, least: float = 0.98, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Links between vectors of one label with cosine of at least ``least``, found by a forest.

    table(vec_id, embedding, label, ...) -> (vec_id, n_links, component_id, kept), one row for each input
    row; other columns are ignored. Equal vectors of a label are one node with its copies. Each tree
    splits a label's vectors at random hyperplanes until leaves hold at most ``leaf``; those near a
    plane go to both sides. Vectors in a leaf are compared by exact cosine in double precision; a pair that
    several leaves hold counts once. A leaf that can't be split is compared in pairs of bounded
    pieces, so none is cut short. Tasks return a count for each row and a spanning forest, not pairs.

    A pair is missed only if in every tree some split has both outside its band on different sides: at cosine ``least`` about
    one in a hundred a split, so one in 10**6 of the pairs that far apart after ten splits in six trees, and far fewer of closer ones.
    Null label, and vectors that are null, empty, zero or hold null or non-finite numbers: n_links 0,
    component_id the own vec_id, kept. Vectors of different lengths don't link. Null vec_id: null component unless
    linked. Rows that share a vec_id each get a row; equal vectors among them count as copies. Empty table: no rows.
    """
    spark = table.sparkSession
    small_batches(spark)
    good = F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = table.select("vec_id", F.col("label"), F.col("embedding").alias("vec")).withColumn("good", good)
    # a node's number is a hash of its label and vector
    keyed = rows.withColumn("rid", F.when(F.col("good"), F.xxhash64("label", "vec")))
    distinct = pinned(keyed.where("good").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("rid").alias("rid")))
    placed = _forest(distinct.select("rid", "label", "vec"), trees, leaf, least)
    own = placed.groupBy("rid").agg(F.sort_array(F.collect_list("node")).alias("inside"))  # a few nodes a tree
    crowd = pinned(placed.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
    met = (
        placed.join(if_small(crowd), "node")
        .join(own.join(distinct.select("rid", "copies"), "rid"), "rid")
        .withColumn("c", F.ceil(F.col("n") / leaf).cast("int"))
        .withColumn("p", F.expr("cast(pmod(xxhash64(rid, 5), c) as int)"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("node", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), 1).otherwise(2).cast("int").alias("side"), "rid", "copies", "vec", "inside")
    )

    def compare(key, t):
        t = t.combine_chunks().sort_by("rid")
        rid, side, copies = (t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("rid", "side", "copies"))
        inside = t.column("inside").combine_chunks()
        size = inside.value_lengths().to_numpy(zero_copy_only=False)
        nodes = np.zeros((len(rid), size.max(initial=1)), dtype=np.int64)
        nodes[np.arange(nodes.shape[1])[None, :] < size[:, None]] = inside.flatten().to_numpy()
        links, root = _compared(side, rid, copies, unit(_vectors(t.column("vec").combine_chunks())), nodes, key[0].as_py(), least)
        some = (links > 0) | (root != np.arange(len(rid)))
        return pa.table({"rid": pa.array(rid[some]), "links": pa.array(links[some]), "root": pa.array(rid[root[some]])})

    found = pinned(met.groupBy("node", "lo", "hi").applyInArrow(compare, "rid long, links long, root long"))
    roots = connected(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    named = pinned(
        distinct.select("rid", "first", "copies").join(linked, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
        .select("rid", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rid").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("low"))
    final = pinned(named.join(lowest, "root").select("rid", "links", "low"))
    return (
        keyed.select("vec_id", "rid").join(if_small(final), "rid", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


ORACLE_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) as (select vec_id, vec_id from v union select r.x, l.b from reach r join link l on l.a = r.y)
select x as vec_id, (select count(*) from link where a = x) as n_links, min(y) as component_id, min(y) = x as kept from reach group by x
"""
