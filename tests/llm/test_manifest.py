"""Merkle manifest against a plain loop, on odd rows and at uneven sizes."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from claimsift.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and each item's runs: its place among the members of each."""
    paths, spot = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[a : a + 3] for a in range(0, len(level), 3)]
        for k, s in enumerate(spot):
            paths[k].append((s % 3, runs[s // 3]))
        spot, level = [s // 3 for s in spot], [sha("".join(r)) for r in runs]
    return level[0], paths


def by_hand(rows):
    """The manifest of (doc_id, text, lang, source, n_chars, ...) rows as a bag."""
    sources: dict = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        other = None
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            other = leaf(doc_id, source, lang, n_chars, text.replace("\n", ""))
        own = leaf(doc_id, source, lang, n_chars, text)
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, own, doc_id, other or own))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(sources[s], key=lambda r: r[:3])]) for s in order}
    root, tops = climb([trees[s][0] for s in order]) if order else ("", [])
    out = Counter()
    for s, top in zip(order, tops):
        for r, path in zip(sorted(sources[s], key=lambda r: r[:3]), trees[s][1]):
            folded, proof = r[4], ""
            for spot, run in path + top:
                others = run[:spot] + run[spot + 1 :]
                proof, folded = proof + "".join(others), sha("".join(run[:spot] + [folded] + run[spot + 1 :]))
            out[r[3], r[2], trees[s][0], root, sha(proof), folded, folded == root] += 1
    return out


def rows_of(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_odd_rows_against_a_loop(spark, odd, odd_rows):
    assert rows_of(merkle.manifest(odd, merkle.without_feeds())) == by_hand(odd_rows)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (4, 81, 1), (82, 10, 9), (244, 1, 2, 27)])
def test_uneven_trees(spark, odd, sizes):
    rows = [(100 * k + i, f"a\nb{i}", "en", f"s{k}", i, "k", 0, None) for k, n in enumerate(sizes) for i in range(n)]
    got = rows_of(merkle.manifest(spark.createDataFrame(rows, odd.schema), merkle.without_feeds()))
    assert got == by_hand(rows)


def test_many_sources(spark, odd):
    rows = [(i, "x\ny", "en", None if i == 5 else f"s{i % 90}", i, "k", 0, None) for i in range(130)]
    got = rows_of(merkle.manifest(spark.createDataFrame(rows, odd.schema), merkle.without_feeds()))
    assert got == by_hand(rows)


def test_untampered_rows_verify(spark, odd, none):
    assert all(r.verified for r in merkle.manifest(odd).collect())
    assert merkle.manifest(none).collect() == []


def test_labels_nest(spark, odd):
    """Every node lies in its parent's interval, and siblings share it without a gap."""
    rows = [(i, "t", "en", "s", i, "k", 0, None) for i in range(200)]
    from pyspark.sql import functions as F

    from claimsift.llm.ranks import numbered

    ranked = numbered(merkle.leaves(spark.createDataFrame(rows, odd.schema)), ["tree"], [F.col("doc_id")], "test")
    made, _ = merkle.grown(ranked.withColumnRenamed("leaf", "digest"), "test")
    for number, band in enumerate(made):
        found: dict = {}
        for r in merkle.labels(band, number).collect():
            found.setdefault((r.level, r.parent_low, r.parent_high), []).append((r.low, r.high))
        for (_, low, high), spans in found.items():
            spans.sort()
            assert spans[0][0] == low and spans[-1][1] == high
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
