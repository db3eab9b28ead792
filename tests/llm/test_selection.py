"""Importance resampling and language by kernels, against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimsift.llm import checksum, importance, language

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return WORD.findall((text or "").translate(LOWER))


def feature_list(text, runs=1):
    words = word_list(text)
    return [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]


def test_checksums_of_spans():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 200_000).astype(np.uint8)
    starts = rng.integers(0, 90_000, 400)
    lengths = rng.integers(0, 200, 400)
    lengths[:6] = [0, 1, 63, 64, 65, 100_000]
    want = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert checksum.crc32(raw, starts, lengths).tolist() == want
    assert checksum.crc32(raw, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_features_of_odd_texts(odd_rows, runs):
    texts = [r[1] for r in odd_rows] + ["\x00ä9\x7f", "Ä" * 500 + " b", "A", "a\nb"]
    found, words, counts = importance.features(pa.array(texts), runs)
    want = [[zlib.crc32(f.encode()) % 10_000 for f in feature_list(t, runs)] for t in texts]
    assert found.tolist() == [b for w in want for b in w]
    assert counts.tolist() == [len(w) for w in want] and words.tolist() == [len(word_list(t)) for t in texts]
    # A part of an array has buffers that begin elsewhere.
    assert importance.features(pa.array(texts).slice(5, 9), runs)[0].tolist() == [b for w in want[5:14] for b in w]


def by_hand(rows, target, runs=1, buckets=10_000, percent=10, least=20, seed=2024):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    ours = [[code(f) for f in feature_list(t, runs)] for _, t in rows]
    s, t = Counter(b for w in ours for b in w), Counter(code(f) for x in target for f in feature_list(x, runs))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), w in zip(rows, ours):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in w)
        out.append([i, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(word_list(text))])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = n
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("settings", [{}, {"percent": 60, "least": 5}, {"runs": 2, "buckets": 300, "percent": 35, "seed": 5}])
def test_resampled_against_a_loop(spark, odd, odd_rows, settings):
    target = ["alpha40 beta the closing line", None, "", "again again", "é漢😀"]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resampled(odd, items, **settings).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == by_hand([r[:2] for r in odd_rows], target, **settings)


def test_resampled_empty_tables(spark, odd, odd_rows, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance.resampled(none, items).collect() == []
    got = importance.resampled(odd, items).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == by_hand([r[:2] for r in odd_rows], [])


def strings(text):
    """The blended spectrum by a plain loop."""
    data = "".join(chr(b) if chr(b).isalpha() and b < 128 else "_" if b < 128 else chr(b) for b in text.lower().encode())
    return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}


def test_presence_is_the_spectrum(odd_rows, monkeypatch):
    texts = [r[1] or "" for r in odd_rows]
    sets = [language.held_strings(t) for t in texts]
    assert [len(s) for s in sets] == [len(strings(t)) for t in texts]
    model = language.fit(sets[:12], ["a", "b"] * 6, landmarks=8)
    want = language.spectrum(sets, model.strings)
    for size in (7, 1_000_000):
        monkeypatch.setattr(language, "TEXT_BYTES", size)
        assert (language.presence(pa.array(texts), model.column(), len(model.strings)) == want).all()
        assert (language.presence(pa.array(texts).slice(4, 9), model.column(), len(model.strings)) == want[4:13]).all()


def test_kernel_values_and_regression():
    """Kernel values equal those of sets; scores equal ridge regression on Nyström features."""
    texts = ["the cat sat", "the dog ran", "der hund lief", "die katze sass", "the hat", "der hut"]
    labels = ["en", "en", "de", "de", "en", "de"]
    sets = [language.held_strings(t) for t in texts]
    model = language.fit(sets, labels, landmarks=4)
    marks = [2, 3, 0, 1]
    known = set().union(*[strings(texts[k]) for k in marks])
    held = language.spectrum(sets, model.strings)
    part = [strings(t) & known for t in texts]
    want = [[len(x & part[k]) / math.sqrt(len(x) * len(part[k])) for k in marks] for x in part]
    k = model.kernel(held)
    assert np.allclose(k, want)
    values, vectors = np.linalg.eigh(np.array([want[i] for i in marks]))
    phi = np.array(want) @ vectors / np.sqrt(values)
    y = np.array([[1, -1] if x == "de" else [-1, 1] for x in labels], dtype=float)
    w = np.linalg.solve(phi.T @ phi / 6 + language.RIDGE * np.eye(4), phi.T @ y / 6)
    assert np.allclose(k @ model.weights, phi @ w, atol=1e-6)


def test_held_out_accuracy(spark, small):
    got = language.query(spark, small).collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(known)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in known if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_rows_teach_nothing(spark, odd):
    rows = [(i, f"the text number {i} is here", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", "s", 1, "k", 0, None) for i in range(40)]
    assert language.train(spark.createDataFrame(rows, odd.schema)).names == ("yy",)


def test_languages_of_odd_rows(spark, odd, odd_rows, none):
    got = language.predicted(odd, language.train(odd)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    letters = Counter((i, any(c.isalpha() for c in t or "")) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in got) == letters
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.predicted(none, language.train(none)).collect() == []
    assert {r.lang_pred for r in language.predicted(odd, language.train(none)).collect()} == {"und"}


def test_training_sample_is_bounded(spark, odd):
    """A language with nearly all rows takes no more of the sample than another."""
    rows = [(i, f"row {i} of words", "hot" if i % 20 else "rare", "s", 1, "k", 0, None) for i in range(600)] + [(7, "row 7 of words", "hot", "s", 1, "k", 0, None)] * 50
    seen = {}
    fit = language.fit
    language.fit, kept = lambda sets, labels: seen.update(Counter(labels)) or fit(sets, labels), language.fit
    try:
        language.train(spark.createDataFrame(rows, odd.schema), sample=20)
    finally:
        language.fit = kept
    assert seen == {"hot": 10, "rare": 10}
