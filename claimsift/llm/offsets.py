"""Token counts of sections: whole documents encoded once, tokens attributed.

The tokenizer sees each document as one text, as training does, and says which
characters every token covers. Those spans are joined with the spans of the
document's sections by a search in sorted bounds, and a token that covers
characters of several sections is given away by a named rule:

``first``    to the section that holds its first character,
``last``     to the section that holds its last character,
``longest``  to the section that holds most of its characters (the earlier one
             on a tie),
``shared``   to every section it touches, in proportion to its characters.

Characters outside every section count for none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimsift.llm import chunks
from claimsift.llm.bpe import byte_table
from claimsift.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Bytes of text that are encoded at once.
TEXT_BYTES = 4_000_000
RULES = ("first", "last", "longest", "shared")

SECTIONS = "array<struct<section:long,start:long,end:long>>"
COUNTED = "doc_id long, section long, start long, end long, n_tokens double, n_whole long, n_crossing long"


def attribute(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (by the rule), whole tokens and crossing tokens of each section.

    ``starts`` and ``ends`` are sorted and don't overlap. A token is whole in a
    section that holds all its characters, and crossing in one that holds some.
    """
    n = len(starts)
    if not n or not len(spans):
        return np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    a, b = spans[:, 0], spans[:, 1]
    # Sections first .. last - 1 share characters with the token.
    first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    touched = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(a)), touched)
    section = chunks.ragged(np.arange(n), first, touched)
    part = np.minimum(b[token], ends[section]) - np.maximum(a[token], starts[section])
    inside = part == (b - a)[token]
    whole = np.bincount(section[inside], minlength=n)
    crossing = np.bincount(section[~inside], minlength=n)
    if rule == "first":
        weight = ((starts[section] <= a[token]) & (a[token] < ends[section])).astype(float)
    elif rule == "last":
        weight = ((starts[section] < b[token]) & (b[token] <= ends[section])).astype(float)
    elif rule == "longest":
        order = np.lexsort((section, -part, token))
        weight = np.zeros(len(token))
        if len(order):
            weight[order[np.concatenate([[True], token[order][1:] != token[order][:-1]])]] = 1.0
    else:
        weight = part / (b - a)[token]
    return np.bincount(section, weight, n), whole, crossing


class Texts:
    """The bytes of a batch's texts, and which character of the batch each begins or belongs to."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        #: Characters that begin before each byte, and in all.
        self.before = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        self.base = self.before[self.edges]

    def spans(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The characters of the batch that each id covers; ``sizes`` are the bytes of ids.

        A character that several ids make is covered by all of them.
        """
        lengths = sizes[ids]
        if (chunks.sums(lengths, counts) != np.diff(self.edges)).any():
            raise ValueError("the tokenizer does not keep the bytes of its texts")
        ends = np.cumsum(lengths)
        return np.stack([self.before[ends - lengths + 1] - 1, self.before[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def lines(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, number, start and end (characters of the batch) of all lines of some rows."""
        cuts = np.unique(np.concatenate([self.edges, np.flatnonzero(self.raw == 10) + 1]))
        row = np.searchsorted(self.edges, cuts[:-1], "right") - 1
        number = np.arange(len(row)) - np.searchsorted(row, row)
        mine = rows[row]
        return row[mine], number[mine], self.before[cuts[:-1]][mine], self.before[cuts[1:]][mine]


def given_sections(lists: pa.Array, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, name, start and end (characters of the batch, within the text) of all given sections."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    row, flat = np.repeat(np.arange(len(lists)), sizes), lists.flatten()
    name, start, end = (np.asarray(pc.struct_field(flat, k), dtype=np.int64) for k in ("section", "start", "end"))
    if (start[1:] < end[:-1])[row[1:] == row[:-1]].any():
        raise ValueError("sections of a document overlap or are not in order")
    length = np.diff(texts.base)
    return row, name, *(texts.base[row] + np.clip(x, 0, length[row]) for x in (start, end))


def by_line(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, sections)`` with no sections given: lines are cut in the task."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(None).cast(SECTIONS).alias("sections"))


def with_sections(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Give each document of ``docs`` its rows of ``sections`` (doc_id, section,
    start, end; characters from 0, end excluded). One document's sections are
    one value; where they overlap, ``counts`` refuses them with an error. Rows
    that are empty spans are left out and repeated ones are one. A ``doc_id``
    that is null or unknown has no sections."""
    rows = sections.where("start < end").select("doc_id", F.struct("start", "end", "section").alias("s")).distinct()
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    lists = lists.select("doc_id", F.transform("s", lambda x: F.struct(x["section"].alias("section"), x["start"].alias("start"), x["end"].alias("end"))).cast(SECTIONS).alias("sections"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = docs.join(lists, "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce("sections", F.array().cast(SECTIONS)).alias("sections"))


def counts(docs: DataFrame, path: str = TOKENIZER, rule: str = "first") -> DataFrame:
    """Token counts per section of ``docs`` (doc_id, text, sections).

    ``sections`` is a sorted list of spans; spans that overlap are refused with
    an error, and a span is cut where its text ends. Where the list is
    null, the lines of the text are its sections (each with its line feed, none
    in an empty or null text). Every row of ``docs`` gives its own rows, also
    where ``doc_id`` is null or repeated; special tokens count as tokens. A
    token's characters follow from the bytes that its id stands for.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = chunks.encoder(path, spaces=True), byte_table(path)[2]
        for batch in batches:
            for part in chunks.slices(batch, "text", TEXT_BYTES):
                out, texts = coder.encode(part.column("text")), Texts(part.column("text"))
                spans = texts.spans(out["ids"], out["counts"], sizes)
                lists = part.column("sections")
                found = list(zip(texts.lines(np.asarray(lists.is_null())), given_sections(lists, texts)))
                row, name, start, end = (np.concatenate(x) for x in found)
                order = np.argsort(row, kind="stable")
                row, name, start, end = row[order], name[order], start[order], end[order]
                n, whole, crossing = attribute(spans, start, end, rule)
                columns = [part.column("doc_id").take(pa.array(row)), *(pa.array(x.astype(np.int64)) for x in (name, start - texts.base[row], end - texts.base[row]))]
                columns += [pa.array(n.astype(float)), pa.array(whole), pa.array(crossing)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_whole", "n_crossing"])

    return docs.select("doc_id", "text", "sections").mapInArrow(run, COUNTED)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op6: the tokens of every line of every document."""
    return counts(by_line(table(spark, folder, "documents"))).withColumn("n_tokens", F.col("n_tokens").cast("long"))
