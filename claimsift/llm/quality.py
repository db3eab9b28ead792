"""Quality of documents by attention over their passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the
whole text is encoded; gated attention says how much each counts; the weighted
sum of the encodings is scored. Only documents are labelled, so the weights are
learned from the documents' labels alone (multiple-instance learning).

A passage is described by its own text: kinds of characters, lengths of words,
repetition, and counts of hashed words. Language, source and id are never seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.llm import chunks
from claimsift.llm.common import table

PASSAGE_WORDS = 64
# Bytes of text described at once: each takes some fifty bytes of working arrays.
TEXT_BYTES = 1_000_000
BUCKETS = 64
# Labelled documents that the model is fitted on, drawn by a hash of their ids.
FIT_DOCUMENTS = 4096
# Passages of such a document that are learned from, evenly from its whole text.
FIT_PASSAGES = 64
HIDDEN, GATES = 32, 16
EPOCHS, BATCH, RATE, DECAY = 16, 256, 0.01, 1e-4
SEED = 7

# Kinds of bytes: 0 white space, 1 lower case, 2 upper case, 3 digit, 4 point or
# comma, 5 other ASCII, 6 part of a character beyond ASCII.
_KIND = np.full(256, 5, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[ord("."), ord(",")]] = 4
_KIND[128:] = 6
_POWERS = np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)

FEATURES = 7 + 5 + BUCKETS


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and how many each text has: one at least.

    A null text is an empty one, whose only passage is all zeros.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    kind = _KIND[raw]
    inside = np.concatenate([[False], kind != 0, [False]])
    # Words end where their text does.
    starts_here, ends_here = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = edges[:-1][edges[:-1] < edges[1:]]
    starts_here[filled] |= inside[1:-1][filled]
    last = edges[1:][edges[:-1] < edges[1:]] - 1
    ends_here[last] |= inside[1:-1][last]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    doc = np.searchsorted(edges, starts, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    count = np.maximum(-(-words // PASSAGE_WORDS), 1)
    base, first = np.cumsum(count) - count, np.cumsum(words) - words
    total = int(count.sum())
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(starts):
        return out, count
    passage = base[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE_WORDS
    has = np.bincount(passage, minlength=total)
    lengths = ends - starts
    begin = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    finish = np.concatenate([begin[1:], [len(starts)]]) - 1
    at = passage[begin]
    a, b = starts[begin], ends[finish]
    size = (b - a).astype(np.float32)
    for k in range(7):
        seen = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        out[at, k] = (seen[b] - seen[a]) / size
    n = np.maximum(has, 1).astype(np.float32)
    mean = np.bincount(passage, lengths, total) / n
    out[:, 7] = mean / 10
    out[:, 8] = np.sqrt(np.maximum(np.bincount(passage, lengths.astype(float) ** 2, total) / n - mean**2, 0)) / 10
    # Each byte's place in its word; what follows a word counts on and is zero.
    spans = np.diff(np.concatenate([[0], starts, [len(raw)]]))
    where = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), spans)
    with np.errstate(over="ignore"):
        mixed = (raw.astype(np.uint64) + np.uint64(1)) * _POWERS[where & 63]
        mixed[kind == 0] = 0
        names = np.add.reduceat(mixed, starts)
        names ^= names >> np.uint64(29)
        names *= np.uint64(0xBF58476D1CE4E5B9)
    again = np.concatenate([[False], (names[1:] == names[:-1]) & (passage[1:] == passage[:-1])])
    out[:, 9] = np.bincount(passage, again, total) / n
    with np.errstate(over="ignore"):
        distinct = np.unique(names ^ (passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out[:, 10] = np.bincount(passage[distinct], minlength=total) / n
    out[:, 11] = np.log1p(has) / 5
    bucket = (names >> np.uint64(58)).astype(np.int64)
    out[:, 12:] = np.bincount(passage * BUCKETS + bucket, minlength=total * BUCKETS).reshape(total, BUCKETS) / n[:, None]
    return out, count


class Attention:
    """Gated attention over bags: ``a = softmax(w (tanh(V h) * sigmoid(U h)))``."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = (x - p["mean"]) / p["spread"]
        bag, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"x": x, "bag": bag, "first": first, "h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ p["c"] + p["d"]}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, counts)["logit"], -30, 30)))

    def gradients(self, x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, counts)
        dlogit = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - labels) / len(labels)
        dz = dlogit[:, None] * p["c"]
        there = dz[f["bag"]]
        da = (f["h"] * there).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["bag"]])
        dgated = de[:, None] * p["w"]
        dt, dg = dgated * f["g"] * (1 - f["t"] ** 2), dgated * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * there + dt @ p["V"].T + dg @ p["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dpre,
            "b": dpre.sum(0),
            "V": f["h"].T @ dt,
            "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ dlogit,
            "d": dlogit.sum(),
        }


def fit(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = SEED) -> Attention:
    """Learn from bags of passages and their labels (Adam, small batches).

    Without labels every score is one half; with labels of one kind, its share.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    weights: dict[str, np.ndarray] = {
        "mean": x.mean(0) if len(x) else np.zeros(width),
        "spread": x.std(0) + 1e-3 if len(x) else np.ones(width),
        "W": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)),
        "b": np.zeros(HIDDEN),
        "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)),
        "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATES)),
        "w": rng.normal(0, 1 / np.sqrt(GATES), GATES),
        "c": np.zeros(HIDDEN),
        "d": np.array(np.log(share / (1 - share))),
    }
    model = Attention(weights)
    if not 0 < labels.sum() < len(labels):
        return model
    first = np.cumsum(counts) - counts
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), BATCH):
            some, step = order[at : at + BATCH], step + 1
            rows = chunks.ragged(np.arange(len(x)), first[some], counts[some])
            for k, g in model.gradients(x[rows], counts[some], labels[some]).items():
                g = g + DECAY * weights[k]
                moment[k][0] = 0.9 * moment[k][0] + 0.1 * g
                moment[k][1] = 0.999 * moment[k][1] + 0.001 * g * g
                weights[k] = weights[k] - RATE * (moment[k][0] / (1 - 0.9**step)) / (np.sqrt(moment[k][1] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a row without an id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = FIT_DOCUMENTS, column: str = "quality") -> Attention:
    """Fit the model on at most ``sample`` labelled documents that are not held out.

    Features of at most ``FIT_PASSAGES`` passages of each, never texts, come to
    the driver: 80 MB at most. Labels that are null count for nothing; of
    several for one document the largest counts, and of several rows with one
    ``doc_id`` the text with the smallest digest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(column).cast("int").alias("_label"))
    known = known.where("_id IS NOT NULL AND _label IS NOT NULL").where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                x, counts = passages(part.column("text"))
                ends = np.cumsum(counts)
                some = [b - n + np.unique(np.linspace(0, n - 1, min(n, FIT_PASSAGES)).astype(np.int64)) for n, b in zip(counts, ends)]
                raw = [x[rows].tobytes() for rows in some]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_label"), pa.array(raw, pa.binary())], ["_id", "_label", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("_id", "_label", "text")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    texts = texts.groupBy("_id", "_label").agg(F.min_by("text", digest).alias("text"))
    bags = texts.mapInArrow(run, "_id long, _label int, x binary")
    rows = sorted((r["_id"], r["_label"], bytes(r["x"])) for r in bags.collect())
    parts = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, _, x in rows]
    x = np.concatenate(parts).astype(np.float64) if parts else np.zeros((0, FEATURES))
    return fit(x, np.array([len(p) for p in parts], dtype=np.int64), np.array([float(y > 0) for _, y, _ in rows]))


def scorer(model: Attention):
    """A column function that scores whole texts, null ones too."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [model.score(*passages(part.column("text"))) for part in chunks.slices(batch, "text", TEXT_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def scored(docs: DataFrame, model: Attention) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; a column of such a name is replaced.

    Every row is scored by its whole text, repeated ones alike; null and empty
    texts are one passage of zeros. A text is described in one piece, which
    takes some sixty bytes a byte of it.
    """
    with_score = docs.withColumn("score", scorer(model)(F.col("text").cast("string")))
    return with_score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op3: the quality of all documents."""
    docs = table(spark, folder, "documents")
    model = train(docs, table(spark, folder, "labels"))
    rows = scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
