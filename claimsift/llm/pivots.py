"""Exact top-k by inner product with a table of distances to pivots.

Inner products become distances when every candidate gets one more component
that brings all to the same length: the larger the product, the smaller the
distance to the query. Distances of all candidates to a few pivots are computed
once. By the triangle inequality they bound a candidate's distance to a query
from below, hence its score from above. Candidates are looked at in the order of
their bounds, until no bound reaches a query's k-th best score.

Candidates lie in blocks, near ones together, and within a block in batches,
whose least and greatest distances bound all of their members at once. A query
first searches the block of its own vector, which gives it a k-th score to beat,
and then every other block whose bounds leave something to find. There, the
queries that a batch can still give something meet it in one matrix product:
on vectors without structure, where few bounds exclude anything, the search is
that of plain products, and costs little more. Scores are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimsift.llm import vectors
from claimsift.llm.common import stored, table

TOP = 20
QUERY_STEP = 20
# Fixed value of the contract: components are floor(SCALE * x).
SCALE = 64
PIVOTS = 16
# Vectors among which pivots are chosen; any choice gives the same answers.
SAMPLE = 2048
# Candidates of a block, and queries that are sent to it together.
BLOCK = 4096
QUERY_BLOCK = 4096
# Candidates that are scored before queries look at their bounds again.
BATCH = 512

# Whole numbers below this are exact as doubles.
EXACT = 2.0**53


def products(table_: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products with ``q``; beyond the range of a long they stop at its ends."""
    if exact:
        return (table_.astype(float) @ q.astype(float)).astype(np.int64)
    whole = table_.astype(object) @ q.astype(object)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in whole], dtype=np.int64)


def choose(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from one another: each next one is the farthest from those before."""
    if not len(points):
        return points
    chosen = [int(np.argmax(np.linalg.norm(points - points.mean(0), axis=1)))]
    gap = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def search(
    q: np.ndarray,
    q_far: np.ndarray,
    least: float,
    ids: np.ndarray,
    table_: np.ndarray,
    far: np.ndarray,
    length2: float,
    keep: int,
    exact: bool,
) -> tuple[np.ndarray, np.ndarray]:
    """The best ``keep`` candidates that score ``least`` or more, and their scores."""
    own2 = float(q.astype(float) @ q.astype(float))
    bound = np.abs(far - q_far).max(axis=1) if far.shape[1] else np.zeros(len(ids))
    # Rounding may not hide a candidate: bounds are loosened by far more than it.
    most = (own2 + length2 - bound * bound) / 2 + 1e-9 * (own2 + length2) + 1e-3
    order = np.flatnonzero(most >= least)
    order = order[np.argsort(-most[order], kind="stable")]
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(order), BATCH):
        if most[order[a]] < least:
            break
        some = order[a : a + BATCH]
        best, scores = np.concatenate([best, some]), np.concatenate([scores, products(table_[some], q, exact)])
        if len(best) > keep:
            first = np.lexsort((ids[best], ~scores))[:keep]
            best, scores = best[first], scores[first]
        if len(best) == keep:
            least = max(least, float(scores.min()))
    reached = scores >= least if len(best) else np.zeros(0, bool)
    return ids[best[reached]], scores[reached]


def leading(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Of pairs, those among the ``keep`` best of their row: places, row by row, best first."""
    order = np.lexsort((ids, -scores, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[rank < keep]


def search_all(
    q: np.ndarray, q_far: np.ndarray, least: np.ndarray, ids: np.ndarray, table_: np.ndarray, far: np.ndarray, length2: float, keep: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``search`` for many queries at once, where products are exact as doubles.

    Rows of queries, candidates found, their scores, and how many products were
    made. Candidates are put in order of their nearest pivot and cut into
    batches; the batch with the highest bound of any query comes first, and a
    query takes no part in a batch whose bound is below what it has.
    """
    if far.shape[1]:
        order = np.lexsort((far.min(1), far.argmin(1)))
        ids, table_, far = ids[order], table_[order], far[order]
    q, table_, own2 = q.astype(float), table_.astype(float), (q.astype(float) ** 2).sum(1)
    cuts = np.arange(0, len(ids), BATCH)
    most = np.full((len(q), len(cuts)), np.inf)
    if far.shape[1]:
        low, high = np.minimum.reduceat(far, cuts), np.maximum.reduceat(far, cuts)
        gap = np.zeros_like(most)
        for p in range(far.shape[1]):
            gap = np.maximum(gap, np.maximum(low[:, p] - q_far[:, p, None], q_far[:, p, None] - high[:, p]))
        # Rounding may not hide a candidate: bounds are loosened by far more than it.
        most = (own2[:, None] + length2 - gap * gap) / 2 + 1e-9 * (own2[:, None] + length2) + 1e-3
    least, made = least.copy(), 0
    row, held, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for b in np.argsort(-most.max(0), kind="stable"):
        asking = np.flatnonzero(most[:, b] >= least)
        if not len(asking):
            continue
        a, z = cuts[b], min(cuts[b] + BATCH, len(ids))
        values = q[asking] @ table_[a:z].T
        made += values.size
        if z - a > keep:
            least[asking] = np.maximum(least[asking], np.partition(values, z - a - keep, axis=1)[:, z - a - keep])
        i, j = np.nonzero(values >= least[asking][:, None])
        row, held, scores = np.concatenate([row, asking[i]]), np.concatenate([held, a + j]), np.concatenate([scores, values[i, j]])
        best = leading(row, ids[held], scores, keep)
        row, held, scores = row[best], held[best], scores[best]
        ends = np.searchsorted(row, np.arange(len(q)), "right")
        full = np.flatnonzero(ends - np.searchsorted(row, np.arange(len(q))) == keep)
        least[full] = np.maximum(least[full], scores[ends[full] - 1])
    reached = scores >= least[row]
    return row[reached], ids[held[reached]], scores[reached].astype(np.int64), made


def top(embeddings: DataFrame, k: int = TOP, step: int = QUERY_STEP, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by
    ``step``, the ``k`` others of highest inner product of whole components.

    See ``vectors.clean`` for the rows that take part; an empty vector does, as
    zeros. Components beyond the range of a long stop at its ends, scores too.
    """
    rows = stored(vectors.clean(embeddings, lambda x: F.floor(x * SCALE).cast("long")), "pivot-rows")
    members = stored(vectors.classes(rows, k + 1), "pivot-classes")
    queries = rows.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "vec")
    queries = stored(queries.join(members.select("vec", "class_id"), "vec").select("query_id", "class_id"), "pivot-queries")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length2 = float(members.agg(F.max(square)).first()[0] or 0.0)
    exact = length2 < EXACT
    points = vectors.sample(members, SAMPLE)
    lifted = np.column_stack([points, np.sqrt(np.maximum(length2 - (points**2).sum(1), 0))]) if points.size else points
    chosen = choose(lifted, pivots) if length2 < 1e300 else lifted[:0]

    def distances(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                flat = np.stack(part["vec"].to_numpy()).astype(float)
                tall = np.column_stack([flat, np.sqrt(np.maximum(length2 - (flat**2).sum(1), 0))])
                here, there = np.zeros((len(part), len(chosen))), np.zeros((len(part), len(chosen)))
                for i, p in enumerate(chosen):
                    here[:, i] = np.linalg.norm(tall - p, axis=1)
                    # A query's own last component is zero.
                    there[:, i] = np.sqrt(((flat - p[:-1]) ** 2).sum(1) + p[-1] ** 2)
                part["far"], part["query_far"] = list(here), list(there)
                part["near"] = here.argmin(1).astype(np.int32) if len(chosen) else np.int32(0)
                part["gap"] = here.min(1) if len(chosen) else 0.0
                yield part

    asked = queries.select(F.col("class_id").alias("asked")).distinct()
    measured = members.select("class_id", "vec").mapInPandas(
        distances, "class_id long, vec array<bigint>, far array<double>, query_far array<double>, near int, gap double"
    )
    measured = measured.join(asked, F.col("class_id") == F.col("asked"), "left").withColumn("all", F.lit(0))
    placed = vectors.blocks(measured, "all", ["near", "gap", "class_id"], block, "pivot-order")
    placed = stored(placed.select("block", "class_id", "vec", "far", "query_far", F.col("asked").isNotNull().alias("query")), "pivot-blocks")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        ask, have = rows[rows["query"]], rows[~rows["query"]]
        out = {"query_class": [], "class_id": [], "score": []}
        if len(ask) and len(have):
            ids, table_ = have["class_id"].to_numpy(), np.stack(have["vec"].to_numpy())
            far = np.stack(have["far"].to_numpy()).astype(float).reshape(len(ids), -1)
            names, q = ask["class_id"].to_numpy(), np.stack(ask["vec"].to_numpy())
            q_far = np.stack(ask["query_far"].to_numpy()).astype(float).reshape(len(names), -1)
            if exact:
                row, found, scores, _ = search_all(q, q_far, ask["least"].to_numpy(dtype=float), ids, table_, far, length2, k + 1)
                return pd.DataFrame({"query_class": names[row], "class_id": found, "score": scores})
            for name, vec, own, least in zip(names, q, q_far, ask["least"]):
                found, scores = search(vec, own, least, ids, table_, far, length2, k + 1, exact)
                out["query_class"].append(np.full(len(found), name))
                out["class_id"].append(found)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for c, v in out.items()})

    found = "query_class long, class_id long, score long"
    columns = ["block", "part", "class_id", "vec", "far", "query_far", "query", "least"]
    # First the block that a query's own vector lies in.
    none, never = F.lit(None).cast("array<double>"), F.lit(float("-inf"))
    start = placed.where("query").select("block", F.lit(0).cast("long").alias("part"), "class_id", "vec", none.alias("far"), "query_far", F.lit(True).alias("query"), never.alias("least"))
    home = placed.select("block", F.lit(0).cast("long").alias("part"), "class_id", "vec", "far", none.alias("query_far"), F.lit(False).alias("query"), never.alias("least"))
    first = stored(home.select(columns).union(start.select(columns)).groupBy("block", "part").applyInPandas(within, found), "pivot-first")
    reached = first.groupBy("query_class").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    least = reached.select("query_class", F.when(F.col("n") > k, F.col("score").cast("double")).otherwise(never).alias("least"))
    # Then all others, queries in blocks of their own order.
    asking = placed.where("query").join(least, F.col("class_id") == F.col("query_class"), "left").fillna(float("-inf"), ["least"])
    asking = stored(
        vectors.blocks(asking.withColumn("all", F.lit(0)).withColumnRenamed("block", "home"), "all", ["home", "class_id"], query_block, "pivot-asking").withColumnRenamed("block", "part"),
        "pivot-queries-placed",
    )
    wide = len(chosen)
    ends = lambda c, low, high: [f(F.element_at(c, i + 1)).alias(f"{n}{i}") for i in range(wide) for f, n in ((F.min, low), (F.max, high))]
    tables = placed.groupBy("block").agg(F.count("*").alias("n"), *ends("far", "lo", "hi"))
    asked_parts = asking.groupBy("part").agg(F.min("least").alias("least"), F.max(square).alias("own2"), F.min("home").alias("h0"), F.max("home").alias("h1"), *ends("query_far", "qlo", "qhi"))
    last = placed.agg(F.max("block")).first()[0]
    pairs = asked_parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long")))).join(tables, "block")
    gap = F.greatest(F.lit(0.0), F.lit(0.0), *[g for i in range(wide) for g in (F.col(f"lo{i}") - F.col(f"qhi{i}"), F.col(f"qlo{i}") - F.col(f"hi{i}"))])
    most = (F.col("own2") + length2 - gap * gap) / 2 + (F.col("own2") + length2) * 1e-9 + 1e-3
    pairs = stored(pairs.where(most >= F.col("least")).select("block", "part"), "pivot-pairs")
    queried = asking.join(pairs, "part").where("home <> block").select("block", "part", "class_id", "vec", none.alias("far"), "query_far", F.lit(True).alias("query"), "least")
    held = placed.join(pairs, "block").select("block", "part", "class_id", "vec", "far", none.alias("query_far"), F.lit(False).alias("query"), never.alias("least"))
    second = held.select(columns).union(queried.select(columns)).groupBy("block", "part").applyInPandas(within, found)
    return vectors.answers(first.union(second), members, queries, k)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op8: the twenty best of every twentieth vector."""
    return top(table(spark, folder, "embeddings"))


ORACLE = f"""
WITH rows AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE))) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= {TOP}
"""
