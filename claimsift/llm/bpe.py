"""Byte-level BPE of whole texts, long ones as a tree of concatenations.

A long text is halved until its parts are short. The parts are encoded on
whatever task they fall to, then joined in pairs: a window around each cut is
encoded anew and grows until it agrees with both sides, and the window's ids
replace theirs.

When a window agrees. Before a white-space run that follows other text, the
tokenizer always starts anew: such a place is agreed on its own. Inside a run
of letters or of digits, pieces next to each other are right when each pair of
neighbours is what the merges make of the two together; a window whose first
(last) id is the one that the left (right) side has for the same characters
therefore fits there. Everywhere else the window grows on, at worst to the
whole of both sides, where nothing is left to agree with. A special token that
lies across a cut leaves only the first kind of place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimsift.llm import chunks
from claimsift.llm.common import digest128, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Texts of more characters are halved, and their halves, until none has more.
LEAF_CHARS = 16_384
# Characters on either side of a cut in the first window.
WINDOW = 64
# Bytes of text encoded at once.
TEXT_BYTES = 4_000_000

IDS = "doc_id long, ids array<int>"


class Part:
    """A stretch of a text: ids and the characters that each of them covers."""

    def __init__(self, start: int, end: int, ids: np.ndarray, spans: np.ndarray):
        self.start, self.end, self.ids, self.spans = start, end, ids, spans


def _fresh(text: str, at: int) -> bool:
    """Whether a white-space run begins at ``at``, behind other text."""
    return 0 < at < len(text) and bool(_SPACE.match(text[at])) and not _SPACE.match(text[at - 1])


_SPACE = chunks.re.compile(f"[{chunks.SPACE}]")


def _alike(text: str, at: int) -> bool:
    """Whether ``at`` is inside a run of ASCII letters or of ASCII digits."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return a.isascii() and b.isascii() and (a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit())


def join(text: str, left: Part, right: Part, encode, specials: list[str], window: int = WINDOW) -> Part:
    """The ids of ``text[left.start : right.end]`` from those of its two parts.

    ``encode`` gives ids and spans of a string by the tokenizer itself.
    """
    cut, reach = left.end, window
    longest = max((len(s) for s in specials), default=0)
    around = text[max(left.start, cut - longest + 1) : cut + longest - 1]
    crossing = any(s in around for s in specials)
    while True:
        lo, hi = max(left.start, cut - reach), min(right.end, cut + reach)
        # The ids from i on (left) and before j (right) are encoded anew.
        i = int(np.searchsorted(left.spans[:, 0], lo, "right")) - 1 if lo > left.start else 0
        j = int(np.searchsorted(right.spans[:, 1], hi, "left")) + 1 if hi < right.end else len(right.ids)
        i, j = max(i, 0), min(j, len(right.ids))
        a = int(left.spans[i, 0]) if i else left.start
        b = int(right.spans[j - 1, 1]) if j < len(right.ids) else right.end
        ids, spans = encode(text[a:b])
        spans = spans + a
        left_whole, right_whole = a == left.start, b == right.end
        left_fits = left_whole or _fresh(text, a) and (not crossing or a < cut - longest)
        right_fits = right_whole or _fresh(text, b) and (not crossing or b > cut + longest)
        if not left_fits and not crossing and len(ids) and _alike(text, a):
            left_fits = ids[0] == left.ids[i] and spans[0, 1] == left.spans[i, 1] and spans[0, 1] < cut
        if not right_fits and not crossing and len(ids) and _alike(text, b):
            right_fits = ids[-1] == right.ids[j - 1] and spans[-1, 0] == right.spans[j - 1, 0] and spans[-1, 0] > cut
        # A character whose bytes are in several ids must not be cut.
        if left_fits and not left_whole and i and left.spans[i - 1, 1] > a:
            left_fits = False
        if right_fits and not right_whole and j < len(right.ids) and right.spans[j, 0] < b:
            right_fits = False
        if left_fits and right_fits:
            return Part(
                left.start,
                right.end,
                np.concatenate([left.ids[:i] if not left_whole else ids[:0], ids, right.ids[j:] if not right_whole else ids[:0]]),
                np.concatenate([left.spans[:i] if not left_whole else spans[:0], spans, right.spans[j:] if not right_whole else spans[:0]]),
            )
        reach *= 2


def _by_library(coder: chunks.ChunkEncoder):
    def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
        found = coder.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=np.int32), np.array(found.offsets, dtype=np.int64).reshape(-1, 2)

    return encode


def cuts(length: int, leaf: int) -> list[int]:
    """Where a text is cut when it is halved until no part exceeds ``leaf``."""
    parts = 1
    while -(-length // parts) > leaf:
        parts *= 2
    return [length * k // parts for k in range(parts + 1)]


def tree(text: str, parts: list[Part], encode, specials: list[str], window: int = WINDOW) -> Part:
    """Join neighbours, then neighbouring pairs, until one part is left."""
    while len(parts) > 1:
        pairs = [join(text, a, b, encode, specials, window) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0]


def part_of(ids: np.ndarray, at: int, path: str) -> tuple[Part, str]:
    """The part and the text that the ids of a whole number of characters stand
    for; a character in several ids is covered by all of them."""
    stored, starts, lengths = byte_table(path)
    raw = chunks.ragged(stored, starts[ids], lengths[ids])
    text = raw.tobytes().decode()
    ends = np.cumsum(lengths[ids])
    char = np.cumsum((raw & 0xC0) != 0x80)
    spans = np.stack([char[ends - lengths[ids]] - 1, char[ends - 1]], axis=1) + at if len(ids) else np.zeros((0, 2), np.int64)
    return Part(at, at + len(text), ids, spans), text


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, path: str = TOKENIZER, leaf: int = LEAF_CHARS, window: int = WINDOW) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``docs`` (doc_id, text), as the library
    encodes the whole text without adding special tokens.

    A null text is an empty one. Rows may repeat and ``doc_id`` may be null or
    repeated: every row has a row of its own in the result. Only texts longer
    than ``leaf`` characters are shuffled, and one task holds one of them.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > leaf
    size = 2 if len(byte_table(path)[1]) <= 1 << 16 else 4

    def narrow(ids: bytes) -> bytes:
        return np.frombuffer(ids, "<i4").astype(f"<u{size}").tobytes()

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks.encoder(path, spaces=True)
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                out = coder.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(out["ids"], out["counts"])], ["doc_id", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks.encoder(path, spaces=True)
        for batch in batches:
            for part in chunks.slices(batch, "leaf", TEXT_BYTES):
                out = coder.encode(part.column("leaf"))
                ends = np.cumsum(out["counts"]) * 4
                raw = out["ids"].astype("<i4").tobytes()
                ids = [raw[b - 4 * n : b] for n, b in zip(out["counts"], ends)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("doc_id", "digest", "at", "rows")), pa.array(map(narrow, ids), pa.binary())],
                    ["doc_id", "digest", "at", "rows", "ids"],
                )

    def one_text(rows: pd.DataFrame) -> pd.DataFrame:
        coder = chunks.encoder(path, spaces=True)
        rows = rows.sort_values("at")
        text, parts = "", []
        for at, ids in zip(rows["at"], rows["ids"]):
            part = part_of(np.frombuffer(ids, f"<u{size}").astype(np.int32), int(at), path)
            parts.append(part[0])
            text += part[1]
        whole = tree(text, parts, _by_library(coder), coder.specials, window)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "rows": rows["rows"].iloc[:1], "ids": [whole.ids]})

    # Parts are dealt out anew, and equal rows are encoded once and counted.
    n = F.col("n")
    halves = F.pow(F.lit(2), F.ceil(F.log2(n / F.lit(float(leaf))))).cast("long")
    cut = docs.where(long).select("doc_id", digest128(F.col("text")).alias("digest"), F.char_length("text").alias("n"), "text")
    cut = cut.select("doc_id", "digest", "n", "text", halves.alias("halves"))
    cut = cut.select("doc_id", "digest", "n", "text", "halves", F.explode(F.sequence(F.lit(0).cast("long"), F.col("halves") - 1)).alias("k"))
    start, end = F.floor(n * F.col("k") / F.col("halves")), F.floor(n * (F.col("k") + 1) / F.col("halves"))
    cut = cut.select("doc_id", "digest", start.cast("long").alias("at"), F.substring("text", start.cast("int") + 1, (end - start).cast("int")).alias("leaf"))
    spread = cut.groupBy("doc_id", "digest", "at").agg(F.min("leaf").alias("leaf"), F.count("*").alias("rows"))
    with_ids = spread.mapInArrow(leaves, "doc_id long, digest binary, at long, rows long, ids binary")
    # The text is read back from the ids, so that ids are all that travels.
    joined = with_ids.groupBy("doc_id", "digest").applyInPandas(one_text, "doc_id long, rows long, ids array<int>")
    joined = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("doc_id", "ids")
    return docs.where(~long).mapInArrow(short_texts, IDS).union(joined)


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, ids, text)``: the text of each row's ids, special tokens kept.

    Every id stands for fixed bytes; bytes that are no UTF-8 become the
    replacement character. Null ids give a null text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, starts, lengths = byte_table(path)
        pieces = pa.array([stored[a : a + n].tobytes() for a, n in zip(starts, lengths)], pa.large_binary())
        for batch in batches:
            lists = batch.column("ids")
            counts = np.asarray(chunks.pc.fill_null(chunks.pc.list_value_length(lists), 0), dtype=np.int64)
            ends = np.cumsum(counts)
            ids = lists.flatten()
            for a, b in _runs(counts):
                mine = ids.slice(ends[a] - counts[a], ends[b - 1] - (ends[a] - counts[a]))
                raw = (pieces.take(mine).buffers()[2] or pa.py_buffer(b"")).to_pybytes()
                edges = np.concatenate([[0], np.cumsum(chunks.sums(lengths[np.asarray(mine)], counts[a:b]))])
                valid = lists.slice(a, b - a).is_valid().to_pylist()
                texts = [raw[x:y].decode("utf-8", "replace") if v else None for x, y, v in zip(edges, edges[1:], valid)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), lists.slice(a, b - a), pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{IDS}, text string")


def _runs(counts: np.ndarray, ids: int = 1 << 21) -> list[tuple[int, int]]:
    """Stretches of rows with about ``ids`` ids, or one row."""
    if not len(counts):
        return []
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // ids)) + 1).tolist(), len(counts)]
    return list(zip(edges, edges[1:]))


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of every id, and where each begins and how many it has."""
    if path not in _tables:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        back = {letter: bytes([b]) for b, letter in enumerate(chunks.byte_letters())}
        specials = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        pieces = [b""] * (max([*tokenizer.get_vocab().values(), *specials]) + 1)
        for token, i in tokenizer.get_vocab().items():
            pieces[i] = specials.get(i) or b"".join(back[c] for c in token)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        _tables[path] = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths
    return _tables[path]


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op10: all documents encoded and decoded, with digests of both."""
    decoded = decode(encode(table(spark, folder, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
