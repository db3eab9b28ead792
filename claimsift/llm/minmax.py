"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two values, its smallest and its
largest, so that half as many hash evaluations make a signature of a given
length. Signatures are cut into bands; documents that share a band are
candidates, and each link is confirmed on the full sets of shingles.

Copies of one word sequence are one class before anything is compared. Bands
are reduced to their smallest and largest class before the shuffle. Candidates
form clusters, whose texts travel once; a cluster of any size is dealt into
blocks, each with a few hubs of its cluster, and compared there. What blocks
have not connected is compared in pairs of blocks, restricted to bands that
still hold classes of different components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from claimsift.llm import chunks
from claimsift.llm.common import components, digest128, stored, table

# Of an operator: words of a shingle and the least similarity in percent. The
# query's contract asks for shingles of two words; elsewhere they have five.
WORDS, PERCENT = 5, 80
QUERY_WORDS = 2
# Rows of a band (of both kinds of values) and bands. At a similarity of 0.8 all
# bands miss a pair three times in a million, at 0.3 one in thirty meets.
ROWS, BANDS = 6, 42
PERMUTATIONS = ROWS * BANDS // 2
BLOCK = 256
HUBS = 8
# Bytes of text described at once: each takes some fifty bytes of working arrays.
TEXT_BYTES = 1_000_000
# Narrow tables of up to so many rows, some 10 MB, are broadcast after they were counted.
BROADCAST_ROWS = 100_000
# Shingles that are held at once for the sets of a group.
COLUMNS = 8192
# Tasks of the last comparison at most; each group of two blocks is work, though few bytes.
FAR_TASKS = 10_000
SEED = 11

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(SEED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MULTIPLY = _rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all words, how many each text has, and each text's digest of its
    words. Words are lower-cased (A-Z) and parted by ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
    edges = edges - edges[0]
    letter = ~_SPACE[raw]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    filled = edges[:-1][edges[:-1] < edges[1:]]
    begins[filled] |= letter[filled]
    starts = np.flatnonzero(begins)
    counts = np.bincount(np.searchsorted(edges, starts, "right") - 1, minlength=len(texts))
    # One space in front of every word and no other.
    spans = np.diff(np.concatenate([[0], starts, [len(raw)]]))
    where = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), spans)
    with np.errstate(over="ignore"):
        longest = int(where[letter].max()) + 1 if letter.any() else 1
        powers = np.full(longest, _FOLD, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        mixed = np.zeros(len(raw), np.uint64)
        mixed[letter] = _BYTE[raw[letter]] * powers[where[letter]]
        hashes = _mix(np.add.reduceat(mixed, starts)) if len(starts) else np.zeros(0, np.uint64)
    kept = letter.astype(np.int64) + begins
    place = np.concatenate([[0], np.cumsum(kept)])
    plain = np.full(int(place[-1]), 32, np.uint8)
    plain[place[1:][letter] - 1] = raw[letter]
    flat, cut = plain.tobytes(), place[edges]
    digests = [hashlib.md5(flat[a:b], usedforsecurity=False).digest() for a, b in zip(cut, cut[1:])]
    return hashes, counts, digests


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of one text, sorted; one of all words if they are fewer."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = min(width, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * _FOLD + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def signature(items: np.ndarray) -> np.ndarray:
    """The smallest and the largest value under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    x = (items >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, len(x), 512):
            values = _MULTIPLY[:, None] * x[None, a : a + 512] + _ADD[:, None]
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray) -> np.ndarray:
    """One key for each band of a signature."""
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in values.reshape(BANDS, ROWS).T.astype(np.uint64):
            out = _mix(out * _FOLD + column)
    return out.view(np.int64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of sorted sets, as a matrix.

    Shingles that one set alone holds count for none; the others are columns of
    0 and 1, ``COLUMNS`` at a time, whose products with themselves add up.
    """
    n = len(sets)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(flat) else fresh
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1 if len(column) else column
    out = np.zeros((n, n), dtype=np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        held = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), dtype=np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        out += held @ held.T
    return out


def compare(ids: np.ndarray, sets: list[np.ndarray], keys: list[np.ndarray], labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all candidates of a group that are linked.

    Candidates share a key, are not connected by ``labels`` already and have
    sizes that allow for a link; all of them are compared at once. Of the links
    found, those that connect something new are given.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), [len(k) for k in keys])
    order = np.lexsort((owner, flat))
    candidates = np.zeros((n, n), dtype=bool)
    for members in np.split(owner[order], np.flatnonzero(np.diff(flat[order])) + 1):
        if len(members) > 1:
            candidates[members[:, None], members] = True
    candidates &= labels[:, None] != labels
    candidates &= 100 * np.minimum(sizes[:, None], sizes) >= percent * np.maximum(sizes[:, None], sizes)
    candidates &= np.tri(n, k=-1, dtype=bool).T
    some = np.flatnonzero(candidates.any(0) | candidates.any(1))
    if not len(some):
        return []
    shared = overlaps([sets[i] for i in some])
    near = 100 * shared >= percent * (sizes[some][:, None] + sizes[some] - shared)
    group = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for x, y in zip(*np.nonzero(near & candidates[np.ix_(some, some)])):
        a, b = root(int(labels[some[x]])), root(int(labels[some[y]]))
        if a != b:
            group[a] = b
            out.append((int(ids[some[x]]), int(ids[some[y]])))
    return out


def described(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, raw, words, n_shingles, keys)`` per row: digests of the text and of
    its words, the number of its shingles and the keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                hashes, counts, digests = words(part.column("text"))
                ends, sizes, keys = np.cumsum(counts), [], []
                for n, end in zip(counts, ends):
                    items = shingles(hashes[end - n : end], width)
                    sizes.append(len(items))
                    keys.append(bands(signature(items)) if len(items) else np.zeros(0, np.int64))
                columns = [part.column("doc_id"), part.column("raw"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "raw", "words", "n_shingles", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), _raw(), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, raw binary, words binary, n_shingles long, keys array<bigint>")


def _raw():
    return digest128(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("raw")


def _small(df: DataFrame) -> DataFrame:
    """A stored narrow table, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grouped(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(doc_id, raw, words, n_shingles, component_id, first_raw)`` per row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` among the documents reachable by
    links; null only where none of them has an id. Of the rows with that id,
    ``first_raw`` names the text that stands for the group. Texts without words
    have no shingles and are linked with nothing. Rows may repeat.
    """
    rows = stored(described(docs, width), "minmax-rows")
    known = rows.where("n_shingles > 0")
    # Null ids come last; of equal ids the smaller digest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("raw").alias("c"))).alias("first")
    names = known.groupBy("words").agg(first, F.first("keys").alias("keys"))
    names = stored(names.withColumn("class_id", F.monotonically_increasing_id()), "minmax-classes")
    spread = names.select("class_id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi"))
    shared = stored(shared.where("lo <> hi").select(F.col("key").alias("_key"), "lo"), "minmax-bands")
    members = spread.join(_small(shared), F.col("key") == F.col("_key")).select("class_id", "key", "lo")
    members = stored(members, "minmax-members")
    clusters = components(members.select(F.col("lo").alias("a"), F.col("class_id").alias("b")), "minmax-clusters")

    # The text of each candidate class, once.
    wanted = stored(clusters.join(names.select(F.col("class_id").alias("id"), F.col("first.c").alias("_raw")), "id").select("id", "_raw"), "minmax-wanted")
    texts = docs.select(_raw(), F.col("text").cast("string").alias("text")).join(_small(wanted), F.col("raw") == F.col("_raw"))
    texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    keys = members.groupBy(F.col("class_id").alias("id")).agg(F.collect_list("key").alias("keys"))
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "component").join(keys, "id").join(texts, "id")
    placed = stored(placed.select(F.col("component").alias("cluster"), "blocks", "id", "keys", "text"), "minmax-candidates")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id").sort_values("id")
        hashes, counts, _ = words(pa.array(group["text"].to_list(), pa.large_string()))
        ends = np.cumsum(counts)
        sets = [shingles(hashes[end - n : end], width) for n, end in zip(counts, ends)]
        found = compare(group["id"].to_numpy(), sets, [np.asarray(k, dtype=np.int64) for k in group["keys"]], group["label"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    pair = "a long, b long"
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    blocks = placed.select("cluster", mine.alias("i"), "id", "keys", "text", F.col("id").alias("label"))
    # Hubs: the classes that most bands of a large cluster begin with.
    large = placed.where("blocks > 1").select("cluster", "blocks", "id", "keys", "text")
    led = members.groupBy(F.col("lo").alias("id")).agg(F.count("*").alias("led"))
    best = Window.partitionBy("cluster").orderBy(F.desc("led"), "id")
    hubs = large.select("cluster", "blocks", "id").join(led, "id").withColumn("n", F.row_number().over(best)).where(F.col("n") <= HUBS)
    hubs = hubs.select(F.col("id").alias("_id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    everywhere = large.join(hubs, F.col("id") == F.col("_id")).select("cluster", "i", "id", "keys", "text", F.col("id").alias("label"))
    near = stored(blocks.union(everywhere).groupBy("cluster", "i").applyInPandas(links, pair), "minmax-near")

    # Pairs of blocks, for bands whose classes are not connected yet.
    if large.head(1):
        label = components(near, "minmax-near").withColumnRenamed("component", "found")
        labelled = large.select("cluster", "blocks", "id").join(label, "id", "left").withColumn("label", F.coalesce("found", "id")).drop("found")
        apart = members.join(labelled, F.col("class_id") == F.col("id")).groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
        apart = stored(apart.where("l0 <> l1").select(F.col("key").alias("_key")), "minmax-apart")
        left = members.join(_small(apart), F.col("key") == F.col("_key")).groupBy(F.col("class_id").alias("id")).agg(F.collect_list("key").alias("keys"))
        rest = labelled.join(left, "id")
        counts = rest.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        rest = rest.join(counts, "cluster").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rest = stored(rest, "minmax-rest")
        halves = rest.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
        # Two blocks meet only where they share an open band.
        held = rest.select("cluster", "mine", F.explode("keys").alias("key")).distinct()
        other = held.select(F.col("cluster").alias("_cluster"), F.col("mine").alias("_other"), F.col("key").alias("_key"))
        meet = held.join(other, (F.col("cluster") == F.col("_cluster")) & (F.col("key") == F.col("_key"))).select("cluster", "mine", F.col("_other").alias("other")).distinct()
        rest = rest.join(meet, ["cluster", "mine"]).join(large.select("id", "text"), "id")
        pairs = rest.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "keys", "text", "label")
        tasks = max(1, min(FAR_TASKS, -(-halves // block)))
        pairs = pairs.repartition(tasks, "cluster", "i", "j")
        far = stored(pairs.groupBy("cluster", "i", "j").applyInPandas(links, pair), "minmax-far")
        # The far links connect components of the near ones.
        label = label.withColumnRenamed("found", "label")
        named = label.select(F.col("id").alias("_id"), F.col("label").alias("_label"))
        far = far.join(named, F.col("a") == F.col("_id"), "left").select(F.coalesce("_label", "a").alias("a"), "b")
        far = far.join(named, F.col("b") == F.col("_id"), "left").select("a", F.coalesce("_label", "b").alias("b"))
        joined = components(far, "minmax-far").toDF("_label", "_joined")
        ids = label.union(joined.select(F.col("_label"), F.col("_label"))).distinct().toDF("id", "label")
        label = ids.join(joined, F.col("label") == F.col("_label"), "left").select("id", F.coalesce("_joined", "label").alias("label"))
    else:
        label = components(near, "minmax-near").withColumnRenamed("component", "label")
    tagged = names.select(F.col("class_id").alias("id"), F.col("words").alias("_words"), "first").join(label, "id", "left")
    tagged = tagged.withColumn("label", F.coalesce("label", "id"))
    tops = tagged.groupBy("label").agg(F.min("first").alias("top"))
    tagged = tagged.join(tops, "label").select("_words", "top")
    # A text that very many documents are copies of is split at run time.
    found = known.drop("keys").join(tagged, F.col("words") == F.col("_words"))
    columns = ["doc_id", "raw", "words", "n_shingles"]
    alone = rows.where("n_shingles = 0").select(*columns, F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("first_raw"))
    return found.select(*columns, F.col("top.b").alias("component_id"), F.col("top.c").alias("first_raw")).union(alone)


def representatives(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group, and all rows without words."""
    rows = grouped(docs, width, percent)
    chosen = F.col("first_raw").isNull() | (F.col("component_id").eqNullSafe(F.col("doc_id")) & (F.col("first_raw") == F.col("raw")))
    kept = rows.where(chosen).groupBy("doc_id", "raw").agg(F.max(F.col("first_raw").isNotNull()).alias("_one"), F.count("*").alias("_rows"))
    kept = stored(kept.select(F.col("doc_id").alias("_doc"), F.col("raw").alias("_kept"), F.col("_one") & (F.col("_rows") > 1), "_rows").toDF("_doc", "_kept", "_one", "_rows").drop("_rows"), "minmax-kept")
    joined = docs.withColumn("_raw", _raw()).join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_raw") == F.col("_kept")))
    once = joined.where("_one").dropDuplicates(["_doc", "_kept"])
    return joined.where("NOT _one").select(*docs.columns).union(once.select(*docs.columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op7: near duplicates among all documents by shingles of two words."""
    rows = grouped(table(spark, folder, "documents"), QUERY_WORDS)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {QUERY_WORDS} THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s
  FROM texts),
sizes AS (SELECT t.doc_id, count(s) AS n FROM texts t LEFT JOIN shingles USING (doc_id) GROUP BY t.doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_shared
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * n_shared >= {PERCENT} * (x.n + y.n - n_shared)),
reached(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
named AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(n.other, s.doc_id)) AS component_id,
       least(s.doc_id, coalesce(n.other, s.doc_id)) = s.doc_id AS kept
FROM sizes s LEFT JOIN named n USING (doc_id)
"""
