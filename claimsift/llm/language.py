"""Language of documents by string kernels.

Two texts are as near as the share of short byte strings that both hold: the
blended-spectrum presence kernel over strings of one to ``LONGEST`` bytes (bytes
of lower-cased UTF-8, what is neither a letter of ASCII nor beyond it being one
separator). Its value is a scalar product of presence vectors, so a batch of
texts meets all landmarks in one matrix product. The Nyström method turns these
values into features, one for each of the landmarks' directions, and kernel
ridge regression on them, one language against the rest each, is solved exactly.

Strings are told apart by tables, without hashing or sorting: three bytes make
one of some four million numbers, and those that landmarks hold have a column.
Only the text is seen, never source, id or the language column of a scored row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimsift.llm import chunks
from claimsift.llm.common import stored, table

LONGEST = 3
# Labelled documents that the model is fitted on at most, drawn by a hash of
# their ids, evenly from the languages; as many languages at most, by documents.
FIT_DOCUMENTS = 2048
LANGUAGES = 128
# Landmarks among them, evenly from the languages, one of each at least.
LANDMARKS = 64
RIDGE = 1e-3
# Bytes of text whose strings are looked up at once, and texts of one product.
TEXT_BYTES = 1_000_000
PRODUCT_ROWS = 256
UNKNOWN = "und"

# Fixed value of the contract: which rows are held out.
FOLDS, HELD_OUT = 4, 2

# Classes of bytes: 0 separates, letters of ASCII, bytes beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 27 + 128)
KINDS = 27 + 128
# Numbers of strings: those of one byte first, then of two, then of three.
_BASE = [0, KINDS, KINDS + KINDS**2]
STRINGS = KINDS + KINDS**2 + KINDS**3


def presence(texts: pa.Array, column: np.ndarray, columns: int) -> np.ndarray:
    """Which of the strings each text holds, as rows of 0 and 1.

    ``column`` gives the column of each of the ``STRINGS`` numbers, ``columns``
    for none. Every byte of every text is looked at, ``TEXT_BYTES`` at a time.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    out = np.zeros((len(texts), columns + 1), dtype=np.float32)
    if not len(texts):
        return out[:, :columns]
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    flat = out.reshape(-1)
    for a in range(int(edges[0]), int(edges[-1]), TEXT_BYTES):
        b = min(a + TEXT_BYTES, int(edges[-1]))
        # Strings that begin in this part may end in the next.
        kinds = _CLASS[raw[a : min(b + LONGEST - 1, int(edges[-1]))]]
        first, last = np.searchsorted(edges, [a, b - 1], "right") - 1
        cuts = np.clip(edges[first : last + 2], a, b)
        row = np.repeat(np.arange(first, last + 1, dtype=np.int64) * (columns + 1), np.diff(cuts))
        # The bytes that are left of a text at each place.
        left = np.repeat(edges[first + 1 : last + 2], np.diff(cuts)) - np.arange(a, b)
        number = kinds[: b - a].copy()
        flat[row + column[number]] = 1
        for n in range(1, LONGEST):
            size = min(b - a, len(kinds) - n)
            number = number[:size] * KINDS + kinds[n : n + size]
            at = np.where(left[:size] > n, column[_BASE[n] + number], columns)
            flat[row[:size] + at] = 1
    return out[:, :columns]


def held_strings(text: str) -> np.ndarray:
    """The numbers of all strings that a text holds, ascending."""
    kinds = _CLASS[np.frombuffer(text.lower().encode(), np.uint8)].astype(np.int64)
    found, number = [np.unique(kinds)], kinds
    for n in range(1, LONGEST):
        number = number[: len(kinds) - n] * KINDS + kinds[n:]
        found.append(np.unique(number) + _BASE[n])
    return np.concatenate(found)


@dataclass(frozen=True)
class Languages:
    """A fitted model: landmarks' strings, and what turns kernel values into scores.

    ``column`` numbers the strings that some landmark holds, ``landmarks`` is
    (strings x landmarks), divided by each landmark's norm, and ``weights`` is
    (landmarks x languages): the Nyström map times the regression.
    """

    names: tuple[str, ...]
    strings: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def column(self) -> np.ndarray:
        out = np.full(STRINGS, len(self.strings), dtype=np.int32)
        out[self.strings] = np.arange(len(self.strings), dtype=np.int32)
        return out

    def kernel(self, held: np.ndarray) -> np.ndarray:
        """Kernel values of presence rows with all landmarks; 0 for a row without strings."""
        norm = np.sqrt(np.maximum(held.sum(1, dtype=np.float64), 1))
        return (held @ self.landmarks).astype(np.float64) / norm[:, None]

    def score(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language's place and its score, 0 to 1, of each row."""
        values = self.kernel(held) @ self.weights
        best = values.argmax(1) if len(values) else np.zeros(0, np.int64)
        return best, np.clip((values[np.arange(len(values)), best] + 1) / 2, 0, 1)


def spectrum(sets: list[np.ndarray], strings: np.ndarray) -> np.ndarray:
    """Presence rows over ``strings`` (ascending) of texts' string numbers."""
    out = np.zeros((len(sets), len(strings)), dtype=np.float32)
    for row, held in zip(out, sets):
        at = np.searchsorted(strings, held)
        inside = at < len(strings)
        hit = at[inside][strings[at[inside]] == held[inside]]
        row[hit] = 1
    return out


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Languages:
    """Solve the regression for texts' string numbers and their languages.

    Texts come in the order in which landmarks are taken from each language. A
    language's texts weigh as much as any other's together.
    """
    names = tuple(sorted(set(labels)))
    if not names:
        return Languages((), np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)))
    of = np.array([names.index(x) for x in labels])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(of == k)[:each] for k in range(len(names))])
    strings = np.unique(np.concatenate([sets[k] for k in chosen]))
    held = spectrum(sets, strings)
    norm = np.sqrt(np.maximum(held[chosen].sum(1, dtype=np.float64), 1))
    model = Languages(names, strings, (held[chosen] / norm[:, None]).T.astype(np.float32), np.zeros((len(chosen), len(names))))
    values, vectors = np.linalg.eigh(model.kernel(held[chosen]))
    kept = values > 1e-6 * values[-1]
    half = vectors[:, kept] / np.sqrt(values[kept])
    x = model.kernel(held) @ half
    y = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(of)[of] / len(names)
    gram = (x * weight[:, None]).T @ x + ridge * np.eye(x.shape[1])
    solved = np.linalg.solve(gram, (x * weight[:, None]).T @ y)
    return Languages(names, strings, model.landmarks, half @ solved)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a row without an id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, sample: int = FIT_DOCUMENTS, languages: int = LANGUAGES, column: str = "lang") -> Languages:
    """Fit the model on rows of ``docs`` with a language and a text that are not held out.

    At most ``sample`` rows, from each of the ``languages`` with most rows as
    many; only the numbers of the strings they hold come to the driver. Rows
    that repeat are one. Texts without a letter teach nothing.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("string").alias("_lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("_lang").isNotNull() & ~held_out(F.col("doc_id"))).where(F.col("text").rlike(r"\p{L}"))
    draw = F.xxhash64("doc_id", "text").alias("_text")
    keys = stored(known.select("_lang", "doc_id", draw).distinct(), "language-rows")
    counts = keys.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(languages).collect()
    if not counts:
        return fit([], [])
    each = max(1, sample // len(counts))
    named = known.where(F.col("_lang").isin(*[r["_lang"] for r in counts]))
    # Some four times as many as wanted pass by their draw alone, whatever the
    # language holds; those are put in order.
    place = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1 << 30))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["_lang"], max(1, min(1 << 30, (each << 32) // r["n"])))])
    order = Window.partitionBy("_lang").orderBy("_place", "doc_id", "_text")
    keys = keys.withColumn("_place", place).where(F.col("_place") < shares[F.col("_lang")])
    keys = keys.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_place")
    picked = F.broadcast(keys.withColumnRenamed("doc_id", "_id"))
    texts = named.withColumn("_text", F.xxhash64("doc_id", "text")).join(picked.withColumnRenamed("_lang", "_of"), "_text")
    texts = texts.where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_lang") == F.col("_of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                held = held_strings(row.column("text")[0].as_py()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([row.column("_lang"), row.column("_n"), pa.array([held.tobytes()], pa.binary())], ["_lang", "_n", "held"])

    rows = texts.select("_lang", "_n", "text").mapInArrow(run, "_lang string, _n int, held binary")
    rows = rows.groupBy("_lang", "_n").agg(F.min("held").alias("held")).collect()
    rows.sort(key=lambda r: (r["_lang"], r["_n"]))
    return fit([np.frombuffer(r["held"], np.int32) for r in rows], [r["_lang"] for r in rows])


def predicted(docs: DataFrame, model: Languages) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs`` by its whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is all
    where nothing was learned. Rows may repeat, ids too, and ids may be null;
    columns other than ``doc_id`` and ``text`` do not count.
    """
    names = pa.array([*model.names, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = model.column()
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                for a in range(0, part.num_rows, PRODUCT_ROWS):
                    some = part.slice(a, PRODUCT_ROWS)
                    texts = pc.fill_null(some.column("text"), "")
                    letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
                    best, score = np.full(some.num_rows, len(model.names)), np.zeros(some.num_rows)
                    if model.names:
                        at, value = model.score(presence(texts, column, len(model.strings)))
                        best, score = np.where(letters, at, best), np.where(letters, value, score)
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), names.take(pa.array(best)), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op12: the language of all documents."""
    docs = table(spark, folder, "documents")
    rows = predicted(docs, train(docs))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
