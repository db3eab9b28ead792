"""Encode whole texts with a public tokenizer, each distinct chunk of them once.

A tokenizer of the two kinds used here never joins text across the place where
a white-space run begins after other text: whatever stands left of that place
cannot change what comes after it. Cutting a text at all these places gives
chunks (white space, then text) whose encodings, put one after the other, are
the encoding of the whole text. Distinct chunks of a batch are found by Arrow,
encoded once by the tokenizers library and kept for later batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the tokenizers' patterns see it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A mark put before each white-space run; texts that hold it go the plain way.
MARK = "\x00"
# Chunks kept by one worker process; they are forgotten when there are more.
# Those of a byte-level vocabulary, with their white space, are twice as many
# and take more room.
KEPT_CHUNKS = {False: 1_000_000, True: 500_000}
# Longer chunks are encoded whenever they come and not kept.
KEPT_CHARS = 256
# Bytes of text that are worked on at once.
SLICE_BYTES = 8_000_000

# Words whose pieces are known without the library's own splitting.
_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
# Marks that join the letter before them, and what begins a special token:
# there, even the case of a letter may matter before the library has seen it.
_MARKED = "[\u0300-\u036f]|<\\|"
_STOPS = "([a-zß-öø-ÿ])([.,])"
_RUNS = f"[{SPACE}]+"
_PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = [""] * 256, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + more)
            more += 1
    return letters


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[i] : starts[i] + lengths[i]]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``size`` bytes or are one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class ChunkEncoder:
    """One worker's tokenizer with the chunks it has encoded.

    ``spaces``: white space is part of the ids (byte-level vocabulary); else it
    only separates words.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.spaces = spaces
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(byte_letters()))
        self.tail = {c: [t.id for t in self.model.tokenize(c)] for c in ",."}
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.known = 0
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lengths = np.zeros(1 << 14, dtype=np.int64)

    def pieces(self, word: str) -> list[int] | None:
        """The ids of a plain word by the library's merges; None for any other text."""
        if word.isascii() and word.isalpha() and len(word) <= KEPT_CHARS:
            return [t.id for t in self.model.tokenize(word if self.spaces else word.lower())]
        found = _WORD.fullmatch(word)
        if not found or len(word) > KEPT_CHARS:
            return None
        space, letters, end = found.groups()
        if space and not self.spaces:
            return None
        letters = letters if self.spaces else letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(self.letters[32] + letters if space else letters)]
        return ids + self.tail[end] if end else ids

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not known yet."""
        known, lengths, flat, others = [], [], [], []
        for chunk in chunks:
            ids = self.pieces(chunk)
            if ids is None:
                others.append(chunk)
            else:
                known.append(chunk)
                lengths.append(len(ids))
                flat += ids
        for a in range(0, len(others), 4096):
            part = others[a : a + 4096]
            known += part
            for found in self.tokenizer.encode_batch_fast(part, add_special_tokens=False):
                lengths.append(len(found.ids))
                flat += found.ids
        need = self.used + len(flat)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need, len(self.ids)), dtype=np.int32)])
        count = self.known + len(known)
        if count > len(self.starts):
            more = np.zeros(max(count, len(self.starts)), dtype=np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.ids[self.used : need] = flat
        sizes = np.array(lengths, dtype=np.int64)
        self.starts[self.known : count] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.known : count] = sizes
        self.codes.update(zip(known, range(self.known, count)))
        self.known, self.used = count, need

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All chunks, and how many each text has."""
        if not self.spaces:
            if not pc.any(pc.match_substring_regex(texts, _MARKED)).as_py():
                # Fewer distinct words: case goes anyway, and a point or comma
                # behind a letter begins a piece of its own.
                texts = pc.replace_substring_regex(pc.ascii_lower(texts), _STOPS, r"\1 \2")
            lists = pc.ascii_split_whitespace(texts)
        elif pc.any(pc.match_substring(texts, MARK)).as_py():
            lists = pa.array([_PARTS.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            # Where no blank or line feed follows white space, each begins a run.
            cut = texts
            for blank in " \n":
                cut = pc.replace_substring(cut, blank, MARK + blank)
            runs = pc.match_substring_regex(texts, f"[{SPACE}][ \n]")
            if pc.any(runs).as_py():
                others = pc.replace_substring_regex(texts.filter(runs), f"({_RUNS})", MARK + r"\1")
                cut = pc.replace_with_mask(cut, runs, others)
            lists = pc.split_pattern(cut, MARK)
        counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
        return lists.flatten(), counts

    def encode(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Ids of all texts in a row and the number of ids of each; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        chunks, counts = self.cut(texts)
        coded = chunks.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        distinct = coded.dictionary.to_pylist()
        if self.known + len(distinct) > KEPT_CHUNKS[self.spaces]:
            self.forget()
        self.learn([c for c in distinct if c not in self.codes])
        codes = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        for chunk in [c for c in distinct if len(c) > KEPT_CHARS]:
            del self.codes[chunk]
        of = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
        lengths = self.lengths[of]
        return {"ids": ragged(self.ids, self.starts[of], lengths), "counts": sums(lengths, counts)}


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaces: bool) -> ChunkEncoder:
    """This worker process's encoder, with what it has learned so far."""
    key = (path, spaces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]


def whole_texts(path: str, texts: list[str | None]) -> list[list[int]]:
    """The library's own ids of whole texts: what the above must equal."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
