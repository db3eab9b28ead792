"""Lines that repeat or nearly repeat across documents, by a segment-partition join.

Two lines are linked when their edit distance is at most ``limit`` and neither
is shorter than ``least`` characters; equal lines are copies whatever their
length. A line within the limit of a shorter one (or of one as long) contains,
unchanged and near its place, at least one of the ``limit + 1`` segments the
other is split into. Every line therefore puts its own segments into an index
and looks up those of its substrings that could be such a segment, for each
length the other may have. Lines that meet are verified by a bit-parallel edit
distance over the band of diagonals within the limit.

Very common segments are no task of their own: their lines are dealt into
blocks, and pairs of blocks are verified apart. A pair that meets under several
segments is reported under the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.llm.common import components, digest128, stored, table

LIMIT = 2
LEAST = 20
# Lines of one segment that are paired by a join; more are paired in blocks.
SMALL = 32
BLOCK = 256
# Segments with several lines that are broadcast after they were counted.
BROADCAST_KEYS = 1_000_000
# Pairs that one call of the edit distance works on.
PAIRS = 4096


def segments(length: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of the ``limit + 1`` segments, the longer ones last."""
    parts, out, at = limit + 1, [], 0
    for k in range(parts):
        n = length // parts + (k >= parts - length % parts)
        out.append((at, n))
        at += n
    return out


def probes(limit: int) -> list[tuple[int, int, int]]:
    """``(shorter by, segment, shift)`` of every substring that is looked up, in the
    order in which a pair's first meeting is found."""
    out = []
    for less in range(limit + 1):
        for k in range(limit + 1):
            low = max(-k, less - (limit - k))
            high = min(k, less + (limit - k))
            out += [(less, k, shift) for shift in range(low, high + 1)]
    return out


def keyed(texts: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """Lines ``(line_id, text, n)`` under every key they are known by, with the place
    of the key's substring in ``probes``.

    A line's own segments are the probes for equal length without a shift.
    """
    parts = limit + 1
    struct = "struct<probe:int,less:int,k:int,shift:int>"
    table_ = F.array(*[F.struct(F.lit(i), *map(F.lit, p)).cast(struct) for i, p in enumerate(probes(limit))])
    spread = texts.select("line_id", "text", "n", F.explode(table_).alias("p"))
    length, k = F.col("n") - F.col("p.less"), F.col("p.k")
    base, more = F.floor(length / parts).cast("int"), length % parts
    size = base + (k >= parts - more).cast("int")
    at = base * k + F.greatest(F.lit(0), k - (parts - more)) + F.col("p.shift")
    spread = spread.select("line_id", "text", "n", F.col("p.probe").alias("probe"), length.alias("length"), k.alias("k"), at.alias("at"), size.alias("size"))
    spread = spread.where((F.col("length") >= least) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))
    key = F.xxhash64(F.col("length") * parts + F.col("k"), F.substring("text", F.col("at") + 1, F.col("size")))
    return spread.select("line_id", "text", key.alias("key"), "probe")


def first_meeting(long: str, short: str, order: list[tuple[int, int, int]], limit: int) -> int:
    """The first of ``probes`` under which the two lines meet."""
    less, parts = len(long) - len(short), segments(len(short), limit)
    for i, (d, k, shift) in enumerate(order):
        if d == less:
            start, size = parts[k]
            if 0 <= start + shift and long[start + shift : start + shift + size] == short[start : start + size]:
                return i
    return -1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def within(pairs: list[tuple[str, str]], limit: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``limit``.

    Equal ends are set aside. What is left goes through the banded bit-vector
    recurrence of Hyyrö, one machine word for each pair and all pairs at once:
    the band slides down the diagonal, then along the last row.
    """
    out = np.zeros(len(pairs), dtype=bool)
    hard = []
    for i, (x, y) in enumerate(pairs):
        a, b = (_codes(x), _codes(y)) if len(x) >= len(y) else (_codes(y), _codes(x))
        if len(a) - len(b) > limit:
            continue
        differ = np.flatnonzero(a[: len(b)] != b)
        head = int(differ[0]) if len(differ) else len(b)
        a, b = a[head:], b[head:]
        differ = np.flatnonzero(a[len(a) - len(b) :] != b)
        tail = len(b) - 1 - int(differ[-1]) if len(differ) else len(b)
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(b):
            out[i] = len(a) <= limit
        elif len(a) <= limit:
            out[i] = True
        else:
            hard.append((i, a, b))
    hard.sort(key=lambda h: len(h[1]))
    for at in range(0, len(hard), PAIRS):
        part = hard[at : at + PAIRS]
        out[[i for i, _, _ in part]] = _banded([a for _, a, _ in part], [b for _, _, b in part], limit) <= limit
    return out


def _banded(longs: list[np.ndarray], shorts: list[np.ndarray], limit: int) -> np.ndarray:
    """Edit distances, right where they are at most ``limit``; every first string is
    longer than the limit and at least as long as the second."""
    m, n = np.array([len(a) for a in longs]), np.array([len(b) for b in shorts])
    rows, wide = len(m), int(max(m.max(), n.max())) + 2 * limit + 2
    # Two fillers that never match each other.
    first, second = np.full((rows, wide + limit), 0xFFFFFFFF, np.uint32), np.full((rows, wide), 0xFFFFFFFE, np.uint32)
    for i, (a, b) in enumerate(zip(longs, shorts)):
        first[i, limit : limit + len(a)], second[i, : len(b)] = a, b
    one = np.uint64(1)
    top = np.uint64(63)
    vp = np.full(rows, np.uint64(((1 << (limit + 1)) - 1) << (63 - limit)))
    vn = np.zeros(rows, np.uint64)
    dist, across = np.full(rows, limit), np.full(rows, 62)
    down = m - limit
    with np.errstate(over="ignore"):
        for j in range(int(n.max())):
            match = np.zeros(rows, np.uint64)
            for d in range(-limit, limit + 1):
                # Bit 63 is the band's lowest row, limit characters ahead.
                match |= (first[:, limit + j + d] == second[:, j]).astype(np.uint64) << np.uint64(63 - limit + d)
            d0 = (((match & vp) + vp) ^ vp) | match | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            live, sliding = j < n, j < down
            slide = live & sliding
            dist += slide & ((d0 >> top) == 0)
            flat = live & ~sliding
            bit = one << np.maximum(across, 0).astype(np.uint64)
            dist += flat & ((hp & bit) != 0)
            dist -= flat & ((hn & bit) != 0)
            across -= flat
            vp = hn | ~((d0 >> one) | hp)
            vn = (d0 >> one) & hp
    return dist


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, line, id, text)``: the non-blank lines of every document,
    stripped of blanks at both ends, numbered from 0 among all lines. ``row``
    names the document by id and text, ``id`` the line by its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The name is made before, or it would be made anew for every line.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), text.alias("text"))
    rows = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    rows = rows.withColumn("text", F.btrim("text", F.lit("\t\r "))).where("text <> ''")
    return rows.select("doc_id", "row", F.col("line").cast("int").alias("line"), digest128(F.col("text")).alias("id"), "text")


def row_key() -> Column:
    """Names a document by its id and whole text; equal rows have the same name."""
    return F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.col("text").cast("string")).cast("binary")))


def _links(found: list[tuple[int, str, int, str]], probe: np.ndarray, order: list[tuple[int, int, int]], limit: int) -> np.ndarray:
    """Which of the pairs (id, text, id, text; longer first) are linked and meet first here."""
    here = np.array([first_meeting(r, s, order, limit) == p for (_, r, _, s), p in zip(found, probe)], dtype=bool)
    out = np.zeros(len(found), dtype=bool)
    at = np.flatnonzero(here)
    out[at] = within([(found[i][1], found[i][3]) for i in at], limit)
    return out


def links(texts: DataFrame, limit: int = LIMIT, least: int = LEAST, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Links of distinct lines ``(line_id, text, n)``: ``(a, b)`` pairs that connect all
    that is linked, and ``(line_id, n_links)``, the number of all links of a line."""
    order = probes(limit)
    own = [i for i, (less, _, shift) in enumerate(order) if less == 0 and shift == 0]
    spread = keyed(texts.where(F.col("n") >= least), limit, least).withColumn("indexed", F.col("probe").isin(own))
    # Segments of several lines; the smallest and largest line tell, and travel.
    shared = spread.groupBy("key").agg(F.min("line_id").alias("lo"), F.max("line_id").alias("hi"))
    shared = stored(shared.where("lo <> hi").select(F.col("key").alias("_key")), "line-keys")
    if shared.count() <= BROADCAST_KEYS:
        found = spread.join(F.broadcast(shared), F.col("key") == F.col("_key"))
    else:
        found = spread.drop("text").join(shared, F.col("key") == F.col("_key")).join(texts.select("line_id", "text"), "line_id")
    found = stored(found.select("key", "line_id", "text", "probe", "indexed"), "line-found")
    sizes = found.groupBy("key").agg(F.count("*").alias("m"), F.max("indexed").alias("any")).where("any").drop("any")
    members = stored(found.join(sizes, "key").select("key", "m", "line_id", "text", "probe", "indexed"), "line-members")

    def pairwise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(zip(batch["r_id"], batch["r_text"], batch["s_id"], batch["s_text"]))
            kept = _links(found, batch["probe"].to_numpy(), order, limit)
            yield pd.DataFrame({"a": batch["r_id"][kept], "b": batch["s_id"][kept]})

    few = members.where(F.col("m") <= small)
    r = few.select("key", F.col("line_id").alias("r_id"), F.col("text").alias("r_text"), "probe")
    s = few.where("indexed").select("key", F.col("line_id").alias("s_id"), F.col("text").alias("s_text"))
    longer = F.char_length("r_text") > F.char_length("s_text")
    later = (F.char_length("r_text") == F.char_length("s_text")) & (F.col("r_id") > F.col("s_id"))
    pairs = r.join(s, "key").where(longer | later)
    near = stored(pairs.select("r_id", "r_text", "s_id", "s_text", "probe").mapInPandas(pairwise, "a long, b long"), "line-pairs")

    def blockwise(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        size = rows["text"].str.len().to_numpy()
        ids, side, probe, indexed = (rows[c].to_numpy() for c in ("line_id", "side", "probe", "indexed"))
        a, b = np.meshgrid(np.arange(len(rows)), np.flatnonzero(indexed), indexing="ij")
        a, b = a.ravel(), b.ravel()
        fits = (size[a] > size[b]) | (size[a] == size[b]) & (ids[a] > ids[b])
        # Within a block only where the block meets itself.
        fits &= (side[a] != side[b]) if first != second else True
        a, b = a[fits], b[fits]
        group, counts, joined = {int(i): int(i) for i in ids}, {}, []

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for at in range(0, len(a), 4 * PAIRS):
            x, y = a[at : at + 4 * PAIRS], b[at : at + 4 * PAIRS]
            found = [(ids[i], rows["text"].iat[i], ids[j], rows["text"].iat[j]) for i, j in zip(x, y)]
            for (p, _, q, _), linked in zip(found, _links(found, probe[x], order, limit)):
                if linked:
                    p, q = int(p), int(q)
                    counts[p], counts[q] = counts.get(p, 0) + 1, counts.get(q, 0) + 1
                    if root(p) != root(q):
                        group[root(p)] = root(q)
                        joined.append((p, q, 0))
        return pd.DataFrame([*joined, *((p, None, n) for p, n in counts.items())], columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    many = members.where(F.col("m") > small)
    blocks = F.ceil(F.col("m") / block).cast("int")
    many = many.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("line_id"), blocks).cast("int")})
    other = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = other.select(
        "key",
        F.least("mine", "other").alias("i"),
        F.greatest("mine", "other").alias("j"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "line_id",
        "text",
        "probe",
        "indexed",
    )
    blocked = stored(placed.groupBy("key", "i", "j").applyInPandas(blockwise, "a long, b long, n long"), "line-blocks")
    connected = near.union(blocked.where("b IS NOT NULL").select("a", "b"))
    counted = near.select(F.explode(F.array("a", "b")).alias("line_id"), F.lit(1).cast("long").alias("n")).union(
        blocked.where("b IS NULL").select(F.col("a").alias("line_id"), "n")
    )
    return connected, counted.groupBy("line_id").agg(F.sum("n").alias("n_links"))


def classes(docs: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """Every non-blank line of ``docs`` (doc_id, text) and the class it belongs to.

    ``doc_id, row, line, n_links, class_doc_id, class_line, kept``. A class is
    all lines that are equal or connected by links. It is named by its first
    line, by ``doc_id`` (null last), then place; that line is kept and no other.
    ``n_links`` counts the other texts within the limit. Rows that are alike
    have the same decisions, and so do rows of one ``doc_id`` at one place.
    """
    all_lines = lines(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("line").alias("c"))).alias("first")
    texts = all_lines.groupBy("id").agg(first, F.min("text").alias("text"))
    texts = stored(texts.withColumns({"line_id": F.monotonically_increasing_id(), "n": F.char_length("text")}), "line-texts")
    connected, counted = links(texts.select("line_id", "text", "n"), limit, least)
    members = components(connected, "line")
    named = members.join(texts.select(F.col("line_id").alias("id"), "first"), "id")
    names = named.groupBy("component").agg(F.min("first").alias("class_first"))
    named = named.select("id", "component").join(names, "component").select(F.col("id").alias("line_id"), "class_first")
    known = texts.select("id", "line_id", "first").join(named, "line_id", "left").join(counted, "line_id", "left")
    known = known.select(F.col("id").alias("_id"), F.coalesce("class_first", "first").alias("first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    # A line that very many documents share is split at run time.
    placed = all_lines.select("doc_id", "row", "line", "id").join(known, F.col("id") == F.col("_id"))
    kept = F.col("first.b").eqNullSafe(F.col("doc_id")) & (F.col("first.c") == F.col("line"))
    return placed.select("doc_id", "row", "line", "n_links", F.col("first.b").alias("class_doc_id"), F.col("first.c").alias("class_line"), kept.alias("kept"))


def dedup(docs: DataFrame, limit: int = LIMIT, least: int = LEAST) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one, ``n_chars`` set anew.

    A document none of whose non-blank lines stays is dropped; one that had
    none, or loses none, is returned as it is. All columns are kept.
    """
    decided = stored(classes(docs, limit, least).select("row", "line", "kept"), "line-decisions")
    # Rows that are alike decide alike: each place is listed once.
    gone = decided.groupBy("row").agg(
        F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("_gone"), F.max("kept").alias("_any")
    )
    gone = gone.where(F.size("_gone") > 0).withColumnRenamed("row", "_row_gone")
    rows = docs.withColumn("_row_key", row_key()).join(gone, F.col("_row_key") == F.col("_row_gone"), "left")
    rows = rows.where(F.col("_any").isNull() | F.col("_any"))
    all_lines = F.split(F.col("text"), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gone"))
    rebuilt = F.array_join(F.transform(places, lambda i: F.get(all_lines, i)), "\n")
    changed = F.col("_gone").isNotNull()
    out = rows.withColumn("text", F.when(changed, rebuilt).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op4: the class of every line of every document."""
    return classes(table(spark, folder, "documents")).drop("row")


