"""Encodings equal the library's on whole texts; files and trees give them back."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from claimsift.llm import bpe, chunks, offsets, tokenfile

LETTERS = list("aAbéÉßñİΣσς'’strevmdlH.,!  \n\n\t\x0b\x1c\x85\xa0漢٣7😀\x00Å") + ["'s", "'LL", " '", "hello", "  ", ".,", "a.", "the", "ing"]
MARKS = ["́", "̱", "<|", "|>", "<|endoftext|>", "<|startoftext|>"]


def odd_texts(seed: int, marks: bool) -> list[str | None]:
    draw, letters = random.Random(seed), LETTERS + MARKS * marks
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + [None, "", "x" * 900, " " * 900]


@pytest.mark.parametrize("marks", [False, True])
@pytest.mark.parametrize("path, spaces", [(bpe.TOKENIZER, True), (tokenfile.TOKENIZER, False)])
def test_chunks_equal_whole_texts(path, spaces, marks):
    coder = chunks.ChunkEncoder(path, spaces)
    for seed in (1, 2):
        texts = [t.replace("<|", "<") if t and not marks else t for t in odd_texts(seed, marks)]
        out = coder.encode(pa.array(texts, pa.string()))
        got = np.split(out["ids"], np.cumsum(out["counts"])[:-1])
        assert [g.tolist() for g in got] == chunks.whole_texts(path, texts)


@pytest.mark.parametrize("marks", [False, True])
def test_spans_equal_the_librarys(marks):
    """Plain words, characters of several ids and special tokens; null texts have no spans."""
    coder = chunks.ChunkEncoder(bpe.TOKENIZER, True)
    texts = odd_texts(3, marks) + ["plain words, only plain words.", "Élan ünd naïve façade."]
    column = pa.array([None, "before", *texts], pa.string()).slice(2)
    out, held = coder.encode(column), offsets.Texts(column)
    spans = held.spans(out["ids"], out["counts"], bpe.byte_table(bpe.TOKENIZER)[2]) - np.repeat(held.base[:-1], out["counts"])[:, None]
    got = np.split(spans, np.cumsum(out["counts"])[:-1])
    want = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [list(map(tuple, g.tolist())) for g in got] == [e.offsets for e in want]


def test_trees_equal_whole_texts():
    coder = chunks.ChunkEncoder(bpe.TOKENIZER, True)
    encode, draw = bpe._by_library(coder), random.Random(5)
    for _ in range(800):
        some = [draw.choice(LETTERS + MARKS) for _ in range(draw.randint(1, 6))]
        text = "".join(draw.choice(some) for _ in range(draw.randint(1, 150)))
        cuts = bpe.cuts(len(text), draw.choice([3, 7, 20]))
        parts = []
        for a, b in zip(cuts, cuts[1:]):
            ids, spans = encode(text[a:b])
            parts.append(bpe.Part(a, b, ids, spans + a))
        whole, (ids, spans) = bpe.tree(text, parts, encode, coder.specials, draw.choice([1, 2, 16])), encode(text)
        assert whole.ids.tolist() == ids.tolist() and whole.spans.tolist() == spans.tolist()


def test_bpe_of_odd_rows(odd, odd_rows, none):
    got = bpe.decode(bpe.encode(odd, leaf=200, window=8)).collect()
    want = chunks.whole_texts(bpe.TOKENIZER, [r[1] for r in odd_rows])
    row = lambda i, ids, text: (i is None, i or 0, list(ids), text)
    assert sorted(row(r.doc_id, r.ids, r.text) for r in got) == sorted(row(r[0], ids, r[1] or "") for r, ids in zip(odd_rows, want))
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_variable_bytes_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (draw.integers(0, 1 << 32, n, dtype=np.uint64) >> draw.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack(values)
        assert len(control) == -(-n // 4)
        assert tokenfile.unpack(control, data, n).tolist() == values.tolist()


def test_files_of_odd_rows(spark, odd, odd_rows, none, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    tokenfile.write(odd, str(tmp_path / "a"))
    got = tokenfile.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = [np.array([*ids, 2], "<u4") for ids in chunks.whole_texts(tokenfile.TOKENIZER, [r[1] for r in odd_rows])]
    key = lambda i, x: (i is not None, i or 0, x)
    assert sorted(key(r.doc_id, bytes(r.ids)) for r in got) == sorted(key(r[0], x.tobytes()) for r, x in zip(odd_rows, want))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.n_tokens * 4 == len(r.ids) for r in got)
    tokenfile.write(none, str(tmp_path / "b"))
    assert tokenfile.read(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("rule", offsets.RULES)
def test_attribution_against_a_loop(rule):
    draw = random.Random(rule)
    for _ in range(200):
        edges = sorted(draw.sample(range(40), draw.randint(2, 12)))
        starts, ends = np.array(edges[:-1:2]), np.array(edges[1::2])[: len(edges[:-1:2])]
        spans = np.array([(a, a + draw.randint(1, 6)) for a in sorted(draw.choices(range(40), k=15))])
        want = np.zeros(len(starts))
        for a, b in spans:
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
            if rule == "shared":
                want += np.array(parts) / (b - a)
            elif rule == "longest" and max(parts):
                want[parts.index(max(parts))] += 1
            elif rule in ("first", "last"):
                at = a if rule == "first" else b - 1
                want += [float(s <= at < e) for s, e in zip(starts, ends)]
        assert offsets.attribute(spans, starts, ends, rule)[0] == pytest.approx(want)


def test_lines_of_odd_rows(spark, odd, odd_rows, none):
    got = offsets.counts(offsets.by_line(odd)).collect()
    assert sum(r.n_tokens for r in got) == sum(map(len, chunks.whole_texts(bpe.TOKENIZER, [r[1] for r in odd_rows])))
    text = odd_rows[0][1]
    mine = sorted((r.section, text[r.start : r.end]) for r in got if r.doc_id == 0)
    assert [t for _, t in mine] == text.splitlines(keepends=True)
    assert offsets.counts(offsets.by_line(none)).collect() == []
    sections = spark.createDataFrame([(0, 9, 5, 400), (0, 8, 0, 5), (99, 1, 0, 5), (None, 1, 0, 5)], "doc_id long, section long, start long, end long")
    given = offsets.counts(offsets.with_sections(odd, sections)).collect()
    assert sorted((r.doc_id, r.section) for r in given) == [(0, 8), (0, 9)]


def test_sections_of_several_documents_together(spark):
    """Given sections and lines in one batch, spans beyond a text, and spans that overlap."""
    texts = {1: "one two\nthree", 2: "naïve façade", 3: "", 4: None, 5: "a b c"}
    given = [(1, 7, 0, 3), (1, 7, 0, 3), (2, 1, 6, 500), (2, 0, 0, 6), (3, 5, 0, 4), (4, 5, 2, 4), (5, 9, 3, 3), (5, 8, 100, 200), (5, 6, 2, 3)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    sections = spark.createDataFrame(given, "doc_id long, section long, start long, end long")
    both = offsets.with_sections(docs, sections).union(offsets.by_line(docs.where("doc_id = 1"))).coalesce(1)
    got = {(r.doc_id, r.section, r.start, r.end): (r.n_tokens, r.n_whole) for r in offsets.counts(both).collect()}
    spans = lambda i: chunks.ChunkEncoder(bpe.TOKENIZER, True).tokenizer.encode(texts[i], add_special_tokens=False).offsets
    first = lambda i, a, b: sum(a <= s < b for s, _ in spans(i))
    want = {(1, 7, 0, 3): first(1, 0, 3), (2, 0, 0, 6): first(2, 0, 6), (2, 1, 6, 12): first(2, 6, 12), (5, 6, 2, 3): first(5, 2, 3)}
    want |= {(1, 0, 0, 8): first(1, 0, 8), (1, 1, 8, 13): first(1, 8, 13), (3, 5, 0, 0): 0, (4, 5, 0, 0): 0, (5, 8, 5, 5): 0}
    assert {k: n for k, (n, _) in got.items()} == want
    overlapping = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 8)], "doc_id long, section long, start long, end long")
    with pytest.raises(Exception, match="overlap"):
        offsets.counts(offsets.with_sections(docs, overlapping)).collect()
