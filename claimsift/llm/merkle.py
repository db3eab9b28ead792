"""Merkle manifest of a dataset, with nested intervals as labels of its nodes.

Every row is a leaf; ``RUN`` consecutive nodes of a source become one node of
the next level until one is left, the source's subroot, and the subroots become
the root in the same way. A node is labelled by the interval of leaf ranks that
it covers, ``low`` to ``high`` (not included): an ancestor is a node whose
interval holds the leaf's, and siblings are what is left of the parent's
interval when the node's own is taken away.

Levels are bucketed in bands of ``BAND``. The nodes of one band under one node
of the next are at most ``RUN ** BAND`` at the bottom, so a bucket is a bounded
group whatever a source holds: digests are made bucket by bucket upwards, and
on the way down each band's rows meet the labels of their bucket in one
containment join and take over the path of the bucket's top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.llm.checksum import CRC_TABLE, crc32_sql
from claimsift.llm.common import stored, table
from claimsift.llm.ranks import numbered

# Fixed values of the contract: nodes in a run, and which rows are tampered with.
RUN = 3
TAMPERED = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Levels of a band; its buckets hold RUN ** BAND rows of its lowest level.
BAND = 4
WIDTH = RUN**BAND


def field_text(column: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its length in bytes, a colon and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    return F.sha2(F.concat(*[field_text(changed.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """``(tree, doc_id, leaf, tampered)`` of every row.

    ``tree`` stands for the source, empty for null, which so comes first.
    ``tampered`` is the leaf of the changed text, null where that is null.
    """
    rows = docs.select(*FIELDS)
    tampered = F.lit(None).cast("string")
    if changed_text is not None:
        tampered = F.when(changed_text.isNotNull(), leaf_digest(text=changed_text))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest().alias("leaf"),
        tampered.alias("tampered"),
    )


def levels_in_band(items: Column) -> Column:
    """The levels of a band above ``items`` nodes of a tree: until one node is left."""
    return sum([(items > RUN**k).cast("int") for k in range(BAND)], F.lit(0))


def folded(digests: Column, steps: Column) -> Column:
    """The levels above sorted digests, these first, as an array of arrays."""

    def above(row: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / RUN).cast("int"))
        return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(row, k * RUN + 1, RUN), "").cast("binary"), 256))

    start = F.array(digests).cast("array<array<string>>")
    return F.aggregate(F.sequence(F.lit(1), steps), start, lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def grown(items: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Build trees upwards from ``items`` (tree, rank, digest, total).

    Returns the buckets of each band (tree, bucket, items, leaves, rows), where
    ``rows`` are the digests of its levels, and the roots (tree, digest, band,
    at): those that stand in the lowest row of that band. Every band is written
    once and has a ``WIDTH``-th of the buckets of the one below.
    """
    made: list[DataFrame] = []
    total = F.col("total")
    now = items.select("tree", F.col("rank").alias("at"), "digest", total.alias("items"), total.alias("leaves"))
    roots = now.where("items = 1").select("tree", "digest", F.lit(0).alias("band"))
    while True:
        bucketed = now.where("items > 1").withColumn("bucket", F.floor(F.col("at") / WIDTH))
        held = bucketed.groupBy("tree", "bucket", "items", "leaves").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("held"))
        rows = folded(F.transform("held", lambda x: x["digest"]), levels_in_band(F.col("items")))
        band = stored(held.select("tree", "bucket", "items", "leaves", rows.alias("rows")), f"{label}-band-{len(made)}")
        if not band.head(1):
            return made, roots
        made.append(band)
        top = F.element_at(F.element_at("rows", -1), 1)
        over = F.floor((F.col("items") + (WIDTH - 1)) / WIDTH)
        now = band.select("tree", F.col("bucket").alias("at"), top.alias("digest"), over.alias("items"), "leaves")
        roots = roots.unionByName(now.where("items = 1").select("tree", "digest", F.lit(len(made)).alias("band")))


def labels(band: DataFrame, number: int) -> DataFrame:
    """Nodes of a band below its tops, with their own and their parents' intervals.

    ``(tree, bucket, level, low, high, parent_low, parent_high, digest)``.
    """
    lowest = RUN ** (number * BAND)
    flat = band.select("tree", "bucket", "leaves", (F.size("rows") - 1).alias("steps"), F.posexplode("rows").alias("step", "digests"))
    nodes = flat.where("step < steps").select("tree", "bucket", "leaves", "step", F.posexplode("digests").alias("at", "digest"))
    covers = F.array(*[F.lit(lowest * RUN**k).cast("long") for k in range(BAND)])
    cover, begin = F.element_at(covers, F.col("step") + 1), F.col("bucket") * F.lit(lowest * WIDTH).cast("long")
    low, parent = begin + F.col("at") * cover, begin + F.floor(F.col("at") / RUN) * cover * RUN
    return nodes.select(
        "tree",
        "bucket",
        (F.col("step") + number * BAND).alias("level"),
        low.alias("low"),
        F.least(low + cover, F.col("leaves")).alias("high"),
        parent.alias("parent_low"),
        F.least(parent + cover * RUN, F.col("leaves")).alias("parent_high"),
        "digest",
    )


def with_ancestors(items: DataFrame, band: DataFrame, number: int, above: DataFrame) -> DataFrame:
    """Give ``items`` (tree, at, others) of a band's lowest row their path to the root.

    A label joins an item when its parent's interval holds the item's first
    leaf: it is an ancestor (or the item itself) when its own interval does as
    well, and a sibling of one otherwise. ``path`` has both, level by level and
    left to right, an ancestor as a null digest; ``last`` ends a run. ``above``
    has (tree, at, path, ...) of the band's tops.
    """
    first = F.col("at") * F.lit(RUN ** (number * BAND)).cast("long")
    found = items.withColumns({"first": first, "bucket": F.floor(F.col("at") / WIDTH)}).join(labels(band, number), ["tree", "bucket"])
    found = found.where("parent_low <= first AND first < parent_high")
    own = (F.col("low") <= F.col("first")) & (F.col("first") < F.col("high"))
    step = F.struct("level", "low", F.when(~own, F.col("digest")).alias("digest"), (F.col("high") == F.col("parent_high")).alias("last"))
    paths = found.groupBy("tree", "bucket", "at", *[c for c in items.columns if c not in ("tree", "at")])
    paths = paths.agg(F.array_sort(F.collect_list(step)).alias("path"))
    over = above.withColumnsRenamed({"at": "bucket", "path": "rest"})
    return paths.join(over, ["tree", "bucket"]).withColumn("path", F.concat("path", "rest")).drop("rest", "bucket")


def paths(items: DataFrame, made: list[DataFrame], roots: DataFrame, label: str) -> DataFrame:
    """``items`` (tree, at, others) with ``path`` and what ``roots`` has besides.

    ``roots`` has (tree, band, path, ...): the path from each tree's root on.
    """
    tops = roots.withColumn("at", F.lit(0).cast("long"))
    above = tops.where(F.col("band") == len(made)).drop("band")
    for number in range(len(made) - 1, 0, -1):
        now = made[number - 1].where(F.col("items") > WIDTH).select("tree", F.col("bucket").alias("at"))
        joined = with_ancestors(now, made[number], number, above)
        above = stored(joined.unionByName(tops.where(F.col("band") == number).drop("band")), f"{label}-paths-{number}")
    if not made:
        return items.join(above, ["tree", "at"])
    alone = items.join(tops.where("band = 0").drop("band"), ["tree", "at"])
    return with_ancestors(items, made[0], 0, above).unionByName(alone)


def siblings_digest(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda x: x["digest"]), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: runs are put together with the siblings and digested."""

    def step(state: Column, x: Column) -> Column:
        run = F.concat(state["run"], F.coalesce(x["digest"], state["own"]))
        own = F.when(x["last"], F.sha2(run.cast("binary"), 256)).otherwise(state["own"])
        return F.struct(F.when(x["last"], F.lit("")).otherwise(run).alias("run"), own.alias("own"))

    start = F.struct(F.lit("").alias("run"), leaf.alias("own"))
    return F.aggregate(path, start, step, lambda state: state["own"])


def manifest(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """Per row of ``docs``: its leaf, its source's subroot, the root and its proof.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``; the
    last two are recomputed with the leaf of ``changed_text`` where that is not
    null. Rows of a source are ordered by ``doc_id``, null first, and those with
    one ``doc_id`` by their leaf; rows that are alike in all fields have places
    of their own, given out in any order. Null fields, empty texts and null
    sources are values like others; other columns do not count. An empty table
    has no rows.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = numbered(leaves(docs, changed_text), ["tree"], order, "merkle-leaves")
    made, subroots = grown(rows.withColumnRenamed("leaf", "digest"), "merkle-source")
    # The same over the subroots: one tree whose items are the sources' trees.
    subroots = subroots.select(F.lit("").alias("all"), F.col("tree").alias("source"), "band", F.col("digest").alias("subroot"))
    placed = numbered(subroots, ["all"], [F.col("source")], "merkle-subroots").withColumnRenamed("all", "tree")
    upper, root = grown(placed.withColumnRenamed("subroot", "digest"), "merkle-top")
    root = root.select("tree", "band", F.col("digest").alias("root"), F.array().cast("array<struct<level:int,low:bigint,digest:string,last:boolean>>").alias("path"))
    tops = placed.select("tree", F.col("rank").alias("at"), "source", "band", "subroot").withColumnRenamed("band", "height")
    tops = paths(tops, upper, root, "merkle-top").select(F.col("source").alias("tree"), F.col("height").alias("band"), "subroot", "root", "path")
    tops = stored(tops, "merkle-tops")
    items = rows.select("tree", F.col("rank").alias("at"), "doc_id", "leaf", "tampered")
    found = paths(items, made, tops, "merkle-source")
    found = found.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        siblings_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def without_feeds() -> Column:
    """The contract's tampering: every ``TAMPERED``-th row by its id's CRC loses its line feeds.

    Null where nothing is changed: other rows, null texts and null ids too.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    text = F.col("text").cast("string")
    return F.when(chosen & F.contains(text, F.lit("\n")), F.translate(text, "\n", ""))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op13: the manifest of all documents, half of them tampered with."""
    return manifest(table(spark, folder, "documents"), without_feeds())


def fold_sql(name: str, start: str, runs: str) -> str:
    """Recursive DuckDB SQL that folds the rows of ``start`` over ``runs``."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT f.n, f.tree, f.level + 1, f.spot // {RUN},
         sha256(array_to_string(list_transform(r.members, lambda m: CASE WHEN m.spot = f.spot THEN f.own ELSE m.digest END), '')),
         f.proof || array_to_string(list_transform(list_filter(r.members, lambda m: m.spot <> f.spot), lambda m: m.digest), '')
  FROM {name} f JOIN {runs} r ON r.tree = f.tree AND r.level = f.level AND r.run = f.spot // {RUN}),
{name}_done AS (SELECT n, arg_max(own, level) AS own, arg_max(proof, level) AS proof FROM {name} GROUP BY n)"""


def grow_sql(name: str, start: str) -> str:
    """Recursive DuckDB SQL for all nodes of the trees over the rows of ``start``."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, spot // {RUN}, sha256(string_agg(digest, '' ORDER BY spot)), (items + {RUN - 1}) // {RUN}
  FROM {name} WHERE items > 1 GROUP BY tree, level, spot // {RUN}, items),
{name}_runs AS (
  SELECT tree, level, spot // {RUN} AS run, list({{'spot': spot, 'digest': digest}} ORDER BY spot) AS members
  FROM {name} WHERE items > 1 GROUP BY ALL)"""


def leaf_sql(text: str) -> str:
    """DuckDB SQL for a leaf, with an expression for its text."""
    values = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf_sql('text')} AS leaf,
         CASE WHEN ({crc32_sql('CAST(doc_id AS VARCHAR)')}) % {TAMPERED} = 0
              THEN {leaf_sql("replace(text, chr(10), '')")} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS n,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot,
         count(*) OVER (PARTITION BY tree) AS items
  FROM hashed),
{grow_sql('nodes', 'SELECT tree, 0 AS level, spot, leaf AS digest, items FROM placed')},
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS items FROM nodes WHERE items = 1),
{grow_sql('upper_nodes', "SELECT '' AS tree, 0 AS level, spot, digest, items FROM subroots")},
{fold_sql('folds', "SELECT n, tree, 0 AS level, spot, coalesce(tampered, leaf) AS own, '' AS proof FROM placed", 'nodes_runs')},
{fold_sql('tops', "SELECT d.n, '' AS tree, 0 AS level, s.spot, d.own, d.proof FROM folds_done d JOIN placed p ON p.n = d.n JOIN subroots s ON s.tree = p.tree", 'upper_nodes_runs')}
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(t.proof) AS proof_sha256, t.own AS folded_root, t.own = u.digest AS verified
FROM placed p JOIN tops_done t ON t.n = p.n JOIN subroots s ON s.tree = p.tree JOIN upper_nodes u ON u.items = 1
"""
