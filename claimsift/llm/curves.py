"""Approximate nearest neighbours by several shifted space-filling curves.

Vectors of length one are projected to a few dimensions, shifted, and put in
the order of a Hilbert curve; several projections and shifts give several
orders. Each order is range-partitioned and cut into blocks. A query meets its
own block and those within a reach of it, in every order; what it finds there is
merged and ranked by the exact cosine. The reach is measured on the rows at hand:
a bounded number of queries is answered by brute force, and the reach is the
least by which the orders hold the wanted share of those answers. Every row is
indexed and every equal vector is found with its class, so ties are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimsift.llm import vectors
from claimsift.llm.common import stored, table

NEIGHBOURS = 5
QUERY_STEP = 50
# Orders, dimensions of a projection, bits of a dimension.
CURVES = 10
DIMENSIONS = 8
BITS = 7
# Rows of a block: a query meets three of them at least in every order.
BLOCK = 4096
# Queries answered by brute force, and the share of their answers that the reach
# has to hold: the contract's 0.9 and a margin for the sample's error.
PROBES = 256
RECALL = 0.95
# Vectors that fix the scale of the projections; everything is indexed.
SAMPLE = 4096
SEED = 20260


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with whole coordinates.

    Skilling's transform: coordinates are turned, bit by bit, into the
    transposed index, whose bits are then read across the dimensions.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(dims):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flip ^= np.where(x[:, dims - 1] & q, q - 1, 0)
    x ^= flip[:, None]
    index = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | x[:, i] >> b & 1
    return index


def orders(points: np.ndarray, curves: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Projection, offset and scale of each curve; the shift is in the offset."""
    rng, width, made = np.random.default_rng(seed), points.shape[1], []
    for _ in range(curves):
        axes = np.linalg.qr(rng.normal(size=(width, min(dims, width))))[0]
        flat = points @ axes
        low, high = (np.quantile(flat, p, axis=0) for p in (0.001, 0.999))
        scale = 0.5 / np.maximum(high - low, 1e-9)
        made.append((axes, rng.uniform(0, 0.5, axes.shape[1]) - low * scale, scale))
    return made


def units(rows: np.ndarray) -> np.ndarray:
    # Scaled first, so that very large and very small components survive squaring.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(members: DataFrame, asked: DataFrame, k: int, size: int) -> list[tuple[int, int]]:
    """``(query class, class)``: the ``k`` classes of largest cosine for up to
    ``size`` of the classes in ``asked``, by brute force over all of ``members``."""
    drawn = asked.orderBy(F.xxhash64("asked"), "asked").limit(size)
    probes = members.join(F.broadcast(drawn), F.col("class_id") == F.col("asked")).select("class_id", "vec").collect()
    if not probes:
        return []
    names = np.array([r.class_id for r in probes], dtype=np.int64)
    vecs = units(np.array([r.vec for r in probes], dtype=float))

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Only the best so far of each probe stay from one batch to the next.
        ids, scores = np.zeros((len(names), 0), dtype=np.int64), np.zeros((len(names), 0))
        for part in parts:
            if len(part):
                theirs = part["class_id"].to_numpy()
                found = vecs @ units(np.stack(part["vec"].to_numpy()).astype(float)).T
                found[names[:, None] == theirs] = -np.inf
                ids = np.hstack([ids, np.broadcast_to(theirs, found.shape)])
                scores = np.hstack([scores, found])
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
        rows = np.repeat(names, ids.shape[1])
        out = pd.DataFrame({"probe": rows, "class_id": ids.ravel(), "score": scores.ravel()})
        yield out[np.isfinite(out["score"])]

    found = members.select("class_id", "vec").mapInPandas(best, "probe long, class_id long, score double")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "class_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return [(r.probe, r.class_id) for r in found.select("probe", "class_id").collect()]


def reach(placed: DataFrame, pairs: list[tuple[int, int]], share: float) -> int:
    """The least number of blocks on either side, one at least, within which the
    orders together hold ``share`` of ``pairs``."""
    if not pairs:
        return 1
    spark = placed.sparkSession
    ids = spark.createDataFrame([(int(i),) for i in sorted({i for pair in pairs for i in pair})], "class_id long")
    at = {}
    for r in placed.join(F.broadcast(ids), "class_id").select("curve", "block", "class_id").collect():
        at.setdefault(r.class_id, {})[r.curve] = r.block
    apart = sorted(min(abs(b - at[other][c]) for c, b in at[probe].items()) for probe, other in pairs)
    return max(1, apart[max(0, math.ceil(share * len(apart)) - 1)])


def neighbours(
    embeddings: DataFrame,
    k: int = NEIGHBOURS,
    step: int = QUERY_STEP,
    curves: int = CURVES,
    dims: int = DIMENSIONS,
    bits: int = BITS,
    block: int = BLOCK,
    seed: int = SEED,
    recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``embeddings`` (vec_id,
    embedding) whose id is divisible by ``step``, the ``k`` rows of largest
    cosine that were found; ``recall`` is the share of the true ones that a sample
    of the queries must find. See ``vectors.clean`` for the rows that take part;
    zero vectors don't."""
    rows = vectors.clean(embeddings)
    rows = stored(rows.where(F.exists("vec", lambda x: x != 0)), "curve-rows")
    members = stored(vectors.classes(rows, k + 1), "curve-classes")
    queries = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "vec")
    queries = stored(queries.join(members.select("vec", "class_id"), "vec").select("query_id", "class_id"), "curve-queries")
    points = vectors.sample(members, SAMPLE)
    maps = orders(units(points), curves, dims, seed) if points.size else []
    kind = members.schema["vec"].dataType.simpleString()

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                unit = units(np.stack(part["vec"].to_numpy()).astype(float))
                cells = [np.clip((unit @ axes) * scale + offset, 0, 1) * ((1 << bits) - 1) for axes, offset, scale in maps]
                part["keys"] = list(np.stack([hilbert(c, bits) for c in cells], axis=1))
                yield part

    asked = queries.select(F.col("class_id").alias("asked")).distinct()
    indexed = members.select("class_id", "vec").mapInPandas(keys, f"class_id long, vec {kind}, keys array<bigint>")
    indexed = indexed.join(asked, F.col("class_id") == F.col("asked"), "left")
    spread = indexed.select(F.posexplode("keys").alias("curve", "key"), "class_id", "vec", F.col("asked").isNotNull().alias("query"))
    placed = vectors.blocks(spread, "curve", ["key", "class_id"], block, "curve-order").select("curve", "block", "class_id", "vec", "query")
    far = F.lit(reach(placed, nearest(members, asked, k, PROBES), recall)).cast("long")
    last = placed.agg(F.max("block")).first()[0] or 0
    near = F.explode(F.sequence(F.greatest(F.col("block") - far, F.lit(0)), F.least(F.col("block") + far, F.lit(last))))
    asking = placed.where("query").select("curve", near.alias("block"), "class_id", "vec", F.lit(True).alias("query"))
    met = placed.withColumn("query", F.lit(False)).union(asking)

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        ask, have = rows[rows["query"]], rows[~rows["query"]]
        out = {"query_class": [], "class_id": [], "score": []}
        if len(ask) and len(have):
            ids = have["class_id"].to_numpy()
            by_id = np.argsort(ids)
            ids, table_ = ids[by_id], np.stack(have["vec"].to_numpy()).astype(float)[by_id]
            lengths = np.linalg.norm(table_, axis=1)
            for a in range(0, len(ask), 256):
                some = ask.iloc[a : a + 256]
                q = np.stack(some["vec"].to_numpy()).astype(float)
                scores = (q @ table_.T) / (np.linalg.norm(q, axis=1)[:, None] * lengths)
                n = min(k + 1, len(ids))
                # Everything from the n-th best score on, then by id on ties.
                least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                row, at = np.nonzero(scores >= least[:, None])
                order = np.lexsort((at, -scores[row, at], row))
                row, at = row[order], at[order]
                first = np.searchsorted(row, row)
                kept = np.arange(len(row)) - first < n
                out["query_class"].append(some["class_id"].to_numpy()[row[kept]])
                out["class_id"].append(ids[at[kept]])
                out["score"].append(scores[row[kept], at[kept]])
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})

    found = met.groupBy("curve", "block").applyInPandas(within, "query_class long, class_id long, score double")
    return vectors.answers(found, members, queries, k)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op1: the five nearest of every fiftieth vector."""
    return neighbours(table(spark, folder, "embeddings"))
