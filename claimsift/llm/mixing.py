"""Mix sources to target weights by a schedule of low discrepancy.

Sizes are words. Each source's documents are put in a shuffled order (by the
md5 of ``doc_id``) and read as one endless stream of words that repeats, up to
the source's quota. The quota is cut into blocks of equal length (the last may
be shorter), and every block has a slot of the schedule: slot ``s`` has the point
``frac(s * golden ratio)`` and goes to the next block of the source in whose
share of all blocks the point falls. Points of this kind fill every share evenly
at any time, so sources are mixed evenly from the first slot to the last. A
share may catch a few points more or fewer than it has blocks: surplus points
are passed over, and blocks without one follow at the end. So every block is
taken once, and each source gives its quota, however small, at every size.

Ranks and running sums are made in two or more levels, so that no task holds a
source: within a chunk of rows first, then over the chunks' totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimsift.llm.common import stored, table

# Fixed values of the contract: weights by the source's place, the share of all
# words that is wanted, the most passes over a source.
WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3
PASSES = 2
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = 0.6180339887498949
# Blocks of a schedule, about: a block has the words wanted over this number.
# Each source has one at least, so there are as many more as sources.
SLOTS = 1 << 18
# Slots ranked by one window, and documents summed up by one.
SLOT_CHUNK = 1 << 12
DOCUMENT_CHUNK = 1 << 12
# Cells of the line of points, by which a slot meets the shares near it.
CELLS = 1 << 16


def words(text: Column) -> Column:
    """The number of words; 0 where the text is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: DataFrame) -> DataFrame:
    """``(place, source, source_size, target, quota, low, high)`` per source.

    One row for each source, by code point, null last. Targets share
    ``SHARE_HALVES / 2`` of all words by weight; one that exceeds ``PASSES``
    times its source stops there and the rest is shared anew. The level at
    which nothing more is to be shared is read off the sources in the order in
    which they reach their limit. ``quota`` is the target in whole words, and
    ``low`` to ``high`` its place in the line of all quotas.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    placed = totals.withColumn("place", F.row_number().over(by_name).cast("long"))
    placed = placed.withColumns(
        {"weight": F.element_at(weights, ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")), "cap": F.col("source_size") * PASSES}
    )
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    level = placed.withColumns(
        {
            "all": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
            "full_caps": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "full_weights": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumns(
        {
            "rest": F.col("all") * SHARE_HALVES - F.col("full_caps") * 2,
            "open": (F.col("weights") - F.col("full_weights")) * 2,
        }
    )
    # The first source, in that order, that stays below its limit.
    fits = F.col("rest") * F.col("weight") <= F.col("cap") * F.col("open")
    first = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "place", "rest", "open"))).over(everything)
    level = level.withColumn("first", first)
    capped = F.col("first").isNull() | (F.struct(F.col("cap") / F.col("weight"), "place") < F.struct(F.col("first.col1"), F.col("first.place")))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("first.rest")).cast("double") / F.col("first.open").cast("double")
    )
    quota = F.least(F.round("target").cast("long"), F.col("cap"))
    level = level.withColumn("target", target).withColumn("quota", quota)
    high = F.sum("quota").over(Window.orderBy("place"))
    return level.withColumn("high", high).select(
        "place", "source", "source_size", "target", "quota", (F.col("high") - F.col("quota")).alias("low"), "high"
    )


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(slot, place, block)``: the slot of each block of each source.

    ``sources`` is stored and has ``place`` and ``quota``. Points meet shares by
    cells of the line of all blocks; a source's points are counted in chunks of
    slots and by the chunks' counts. The block of rank ``r`` that no point fell
    to has the slot behind all points that its place in the line gives it.
    """
    spark = sources.sparkSession
    shares = sources.where("quota > 0").withColumn("n", F.ceil(F.col("quota") / block))
    shares = shares.select("place", "n", F.sum("n").over(Window.orderBy("place")).alias("high"))
    shares = stored(shares.withColumn("low", F.col("high") - F.col("n")), "mix-shares")
    total = shares.agg(F.max("high")).first()[0] or 0
    if not total:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("block"))
    point = F.col("id") * F.lit(GOLDEN)
    at = F.least(F.floor((point - F.floor(point)) * F.lit(float(total))), F.lit(total - 1)).cast("long")
    points = spark.range(total).select(F.col("id").alias("slot"), at.alias("at"))
    cell = lambda x: F.floor(x * CELLS / F.lit(float(total)))
    spread = shares.select("place", "n", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    given = points.withColumn("cell", cell(F.col("at"))).join(spread, "cell").where("low <= at AND at < high")
    given = given.select("slot", "place", "n", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    inside = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    counts = given.groupBy("place", "chunk").agg(F.count("*").alias("m"))
    earlier = F.sum("m").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("place", "chunk", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = given.withColumn("inside", inside).join(before, ["place", "chunk"])
    ranked = ranked.select("slot", "place", (F.col("before") + F.col("inside")).cast("long").alias("block"), "n").where("block < n").drop("n")
    caught = counts.groupBy("place").agg(F.sum("m").alias("m"))
    short = shares.join(caught, "place", "left").withColumn("m", F.coalesce("m", F.lit(0))).where("m < n")
    late = short.withColumn("block", F.explode(F.sequence(F.col("m"), F.col("n") - 1)))
    return ranked.union(late.select((F.lit(total) + F.col("low") + F.col("block")).alias("slot"), "place", F.col("block").cast("long")))


def positions(sizes: DataFrame, rows: int) -> DataFrame:
    """Add ``start``: the words of the same source that come before a document.

    ``sizes`` has ``place``, ``draw`` (hexadecimal digits that order a source)
    and ``size``. Running sums go by the digits, two more on each level.
    """
    levels = max(1, math.ceil(math.log(max(rows / DOCUMENT_CHUNK, 1.001), 256)))
    sizes = sizes.withColumn("chunk", F.substring("draw", 1, 2 * levels))
    before = sizes.groupBy("place", "chunk").agg(F.sum("size").alias("n"))
    before = before.select("place", "chunk", "n", F.lit(0).cast("long").alias("before"))
    for level in range(levels, 0, -1):
        # All chunks below one parent, before any chunk of the same parent.
        parent = F.substring("chunk", 1, 2 * (level - 1))
        node = F.substring("chunk", 1, 2 * level)
        nodes = before.groupBy("place", node.alias("node")).agg(F.sum("n").alias("total"))
        siblings = Window.partitionBy("place", F.substring("node", 1, 2 * (level - 1))).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.select(F.col("place").alias("_place"), "node", F.coalesce(F.sum("total").over(siblings), F.lit(0)).alias("earlier"))
        before = before.join(nodes, (F.col("place") == F.col("_place")) & (node == F.col("node"))).select(
            "place", "chunk", "n", (F.col("before") + F.col("earlier")).alias("before")
        )
    order = Window.partitionBy("place", "chunk").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    joined = summed.join(before.drop("n"), ["place", "chunk"])
    return joined.withColumn("start", (F.col("before") + F.col("inside")).cast("long")).drop("chunk", "before", "inside")


def mix(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): what the mix takes of it.

    ``doc_id, source, size, source_size, target, taken``, ``slot``, the first
    slot that takes words of it, and ``heads``, the slots that take its first
    word, one for each pass, with ``key`` if one is given. Each source's
    ``taken`` sum up to its quota. Null sources are one source; null and empty
    texts have size 0 and are never taken: null ``slot``, no ``heads``. Rows may
    repeat and ``doc_id`` may be null or repeated; rows that are alike in
    ``doc_id`` and size may change places. An empty table has no rows.
    """
    key = F.lit(None).cast("binary") if key is None else key
    # Rows without an id are dealt by their texts.
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words(F.col("text").cast("string")).alias("size"),
        F.md5(name.cast("binary")).alias("draw"),
        key.alias("key"),
    )
    sizes = stored(sizes, "mix-sizes")
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = stored(plan(sizes).coalesce(1), "mix-sources")
    block = max(1, -(-(total * SHARE_HALVES // 2) // SLOTS))
    slots = schedule(sources, block)
    # Sources are few against documents; a hot one is split at run time.
    placed = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"]))
    placed = placed.select("doc_id", sizes["source"], "size", "draw", "key", "place", "source_size", "target", "quota")
    filled = stored(positions(placed.where("size > 0"), rows), "mix-positions")
    once = filled.withColumn("pass", F.explode(F.array(*[F.lit(p).cast("long") for p in range(PASSES)])))
    once = once.withColumn("from", F.col("pass") * F.col("source_size") + F.col("start")).where("from < quota")
    once = once.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota")))
    first, last = F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)
    pieces = once.withColumn("first", first).withColumn("block", F.explode(F.sequence(first, last)))
    pieces = pieces.withColumn("words", F.least("to", (F.col("block") + 1) * block) - F.greatest("from", F.col("block") * block))
    pieces = pieces.select("place", "block", "start", "words", (F.col("block") == F.col("first")).alias("head"))
    taken = pieces.join(slots, ["place", "block"]).groupBy("place", "start")
    taken = taken.agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"), F.array_sort(F.collect_list(F.when(F.col("head"), F.col("slot")))).alias("heads"))
    # Where a document has words, no other of its source starts there.
    joined = filled.join(taken, ["place", "start"], "left")
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "slot", "heads", "key"]
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    whole = joined.withColumns({"taken": F.coalesce("taken", zero), "heads": F.coalesce("heads", none)})
    empty = placed.where("size = 0").withColumns({"taken": zero, "slot": F.lit(None).cast("long"), "heads": none})
    return whole.select(*out).union(empty.select(*out))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix in the order of their slots, as often as they begin in one.

    Whole documents stand for the words of a quota: a pass over a source gives
    those whose first word the quota has, so every source reaches its target,
    and a document stands where the slot of its first word does. The rows are
    dealt by ranges of slots and sorted; columns are those of ``docs``, whatever
    their names. Rows that are alike in all of them are one that is taken
    several times.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key = F.unhex(F.md5(F.to_json(row, exact).cast("binary")))
    taken = mix(docs, key).select(F.col("key").alias("taken_key"), F.explode("heads").alias("slot"))
    rows = docs.select(row.alias("row"), key.alias("row_key")).dropDuplicates(["row_key"])
    found = rows.join(taken, F.col("row_key") == F.col("taken_key")).select("row", "slot")
    return found.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op5: the mix of all documents."""
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slot")


ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS draw
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place
  FROM sizes GROUP BY source),
capped AS (
  SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS BIGINT) AS weight, {PASSES} * source_size AS cap
  FROM totals),
level AS (
  SELECT *, {SHARE_HALVES} * CAST(sum(source_size) OVER () AS BIGINT)
           - 2 * coalesce(CAST(sum(cap) OVER w AS BIGINT), 0) AS rest,
         2 * (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0)) AS open,
         row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place) AS turn
  FROM capped WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
below AS (SELECT rest, open, turn FROM level WHERE rest * weight <= cap * open ORDER BY turn LIMIT 1),
targets AS (
  SELECT l.*, CASE WHEN b.turn IS NULL OR l.turn < b.turn THEN CAST(l.cap AS DOUBLE)
                   ELSE CAST(l.weight * b.rest AS DOUBLE) / CAST(b.open AS DOUBLE) END AS target
  FROM level l LEFT JOIN below b ON true),
quotas AS (SELECT *, least(CAST(round(target) AS BIGINT), cap) AS quota FROM targets),
figures AS (
  SELECT greatest(1, ({SHARE_HALVES} * CAST(sum(source_size) AS BIGINT) // 2 + {SLOTS - 1}) // {SLOTS}) AS block
  FROM quotas),
sources AS (
  SELECT *, (quota + block - 1) // block AS n, CAST(sum((quota + block - 1) // block) OVER (ORDER BY place) AS BIGINT) AS high
  FROM quotas, figures),
line AS (SELECT coalesce(max(high), 0) AS line FROM sources),
points AS (
  SELECT slot, least(CAST(floor((slot * CAST({GOLDEN} AS DOUBLE) - floor(slot * CAST({GOLDEN} AS DOUBLE))) * CAST(line AS DOUBLE)) AS BIGINT), line - 1) AS spot
  FROM line, range((SELECT line FROM line)) r(slot)),
caught AS (
  SELECT place, n, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block
  FROM points JOIN sources ON spot >= high - n AND spot < high),
missed AS (
  SELECT s.place, unnest(range(coalesce(c.m, 0), s.n)) AS block, s.high - s.n AS low
  FROM sources s LEFT JOIN (SELECT place, count(*) AS m FROM caught GROUP BY place) c ON c.place = s.place),
slots AS (
  SELECT place, block, slot FROM caught WHERE block < n
  UNION ALL SELECT place, block, (SELECT line FROM line) + low + block FROM missed),
placed AS (
  SELECT z.doc_id, z.size, s.place, s.source_size, s.target, s.quota,
         CAST(sum(z.size) OVER (PARTITION BY s.place ORDER BY z.draw, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - z.size AS start
  FROM sizes z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
passes AS (
  SELECT p.*, n * source_size + start AS lo, least(n * source_size + start + size, quota) AS hi
  FROM placed p, range({PASSES}) r(n) WHERE size > 0 AND n * source_size + start < quota),
pieces AS (
  SELECT *, unnest(range(lo // block, (hi - 1) // block + 1)) AS piece FROM passes, (SELECT block FROM figures)),
taken AS (
  SELECT p.place, p.doc_id, p.start, min(slot) AS slot, sum(least(hi, (piece + 1) * p.block) - greatest(lo, piece * p.block)) AS taken
  FROM pieces p JOIN slots s ON p.place = s.place AND p.piece = s.block GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(CASE WHEN p.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END AS BIGINT) AS taken,
       CASE WHEN p.size > 0 THEN t.slot END AS slot
FROM placed p LEFT JOIN taken t ON p.place = t.place AND p.start = t.start AND p.doc_id IS NOT DISTINCT FROM t.doc_id
"""
