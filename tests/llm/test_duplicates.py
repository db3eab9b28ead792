"""Near-duplicate lines and documents against brute force."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from claimsift.llm import linedup, minmax
from claimsift.llm.common import components


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def edited(text: str, draw: random.Random, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        at = draw.randint(0, max(len(out) - 1, 0))
        kind = draw.random()
        if kind < 0.4 and out:
            out[at] = draw.choice("abcé")
        elif kind < 0.7:
            out.insert(at, draw.choice("abcé"))
        elif out:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_band_and_segments_against_the_table(limit):
    draw = random.Random(limit)
    pairs = []
    for _ in range(3000):
        a = "".join(draw.choice("ab") for _ in range(draw.randint(0, 25)))
        pairs.append((a, edited(a, draw, draw.randint(0, 5))))
    near = np.array([distance(a, b) <= limit for a, b in pairs])
    assert (linedup.within(pairs, limit) == near).all()
    order = linedup.probes(limit)
    for (a, b), linked in zip(pairs, near):
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        if linked and len(b) > limit:
            assert linedup.first_meeting(a, b, order, limit) >= 0


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("small", [32, 1])
def test_links_against_all_pairs(spark, small, monkeypatch):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(18, 60))) for _ in range(12)]
    lines = sorted({edited(draw.choice(base), draw, draw.randint(0, 4)) for _ in range(150)})
    texts = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(lines)], "line_id long, text string, n int")
    connected, counted = linedup.links(texts, 2, 20, small=small, block=7)
    want = [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and min(len(a), len(b)) >= 20 and distance(a, b) <= 2]
    counts = {}
    for pair in want:
        for i in pair:
            counts[i] = counts.get(i, 0) + 1
    assert {r.line_id: r.n_links for r in counted.collect()} == counts
    ours = grouped(range(len(lines)), [(r.a, r.b) for r in connected.collect()])
    theirs = grouped(range(len(lines)), want)
    assert len({(ours[i], theirs[i]) for i in ours}) == len(set(ours.values())) == len(set(theirs.values()))


def test_lines_of_odd_rows(odd, odd_rows, none):
    got = linedup.classes(odd).collect()
    lines = [(r[0], n, x.strip("\t\r ")) for r in odd_rows for n, x in enumerate((r[1] or "").split("\n")) if x.strip("\t\r ")]
    assert len(got) == len(lines)
    closing = [r for r in got if (r.class_doc_id, r.class_line) == (0, 3)]
    assert len(closing) == sum(x == "The same closing line in every text." for _, _, x in lines)
    assert [r.doc_id for r in closing if r.kept] == [0]
    assert linedup.classes(none).collect() == []


def test_dedup_of_odd_rows(odd, odd_rows, none):
    out = linedup.dedup(odd)
    assert out.columns == odd.columns
    got = out.collect()
    closing = "The same closing line in every text."
    assert sum(closing in (r.text or "") for r in got) == 1
    # Copies of document 3 lose all their lines; rows without lines stay as they are.
    assert 30 not in {r.doc_id for r in got}
    assert {20, 21, 22, 23} <= {r.doc_id for r in got} and sum(r.doc_id is None for r in got) == 2
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert linedup.dedup(none).collect() == []


def sets(rows, width):
    out = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        n = min(width, len(words))
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    return out


@pytest.mark.parametrize("width, block", [(2, 256), (5, 2)])
def test_documents_against_all_pairs(spark, odd, odd_rows, none, width, block):
    draw = random.Random(4)
    base = odd_rows[0][1].split()
    more = []
    for i in range(40):
        words = list(base)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(len(words))] = f"new{draw.randint(0, 5)}"
        more.append((100 + i, " ".join(words), *odd_rows[0][2:]))
    rows = odd_rows + more
    docs = spark.createDataFrame(rows, odd.schema)
    shingles = sets(rows, width)
    linked = []
    for i, a in enumerate(shingles):
        for j in range(i):
            both = len(a & shingles[j])
            if a and shingles[j] and 100 * both >= 80 * (len(a) + len(shingles[j]) - both):
                linked.append((i, j))
    group = grouped(range(len(rows)), linked)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[group[i]] = min(first.get(group[i], r[0]), r[0])
    key = lambda i, n, c: (i is None, i or 0, n, c is None, c or 0)
    want = sorted(key(r[0], len(shingles[i]), first.get(group[i])) for i, r in enumerate(rows))
    got = minmax.grouped(docs, width, block=block).collect()
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert minmax.grouped(none, width).collect() == []


def test_one_document_of_each_group_stays(odd, odd_rows, none):
    out = minmax.representatives(odd)
    assert out.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    # 3 (thrice) and 30 are copies, WORD is word; without words all rows stay.
    assert got.count((False, 3)) == 1 and (False, 30) not in got and (False, 24) not in got
    assert {(False, 20), (False, 21), (False, 22), (False, 23)} <= set(got) and got.count((True, 0)) == 2
    assert minmax.representatives(none).collect() == []


def test_signatures_estimate_similarity():
    items = np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.unique(items[:800]), np.unique(items[200:])
    same = (minmax.signature(a) == minmax.signature(b)).mean()
    assert abs(same - 0.6) < 0.1


def test_a_band_shared_by_many_unlinked_texts():
    """All pairs of 500 texts at once: as many links as connect what is linked, in little time."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 20, rng.integers(20, 60), dtype=np.uint64)) for _ in range(500)]
    for k in range(0, 60, 3):
        sets[k + 1] = sets[k][1:]
        sets[k + 2] = sets[k + 1][1:]
    sets[99] = np.zeros(0, np.uint64)
    ids, keys, labels = np.arange(1000, 1500), [np.array([7])] * 500, np.arange(500)
    start = time.process_time()
    got = minmax.compare(ids, sets, keys, labels, 80)
    assert time.process_time() - start < 5
    plain = [set(s.tolist()) for s in sets]
    linked = [(i, j) for j in range(500) for i in range(j) if plain[j] and 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])]
    assert all((a - 1000, b - 1000) in linked for a, b in got)
    assert grouped(range(500), [(a - 1000, b - 1000) for a, b in got]) == grouped(range(500), linked)
    assert len(got) == 500 - len(set(grouped(range(500), linked).values()))
    # What is connected already is not compared, and nothing without a common key.
    assert minmax.compare(ids, sets, keys, np.zeros(500, np.int64), 80) == []
    assert minmax.compare(ids, sets, [np.array([i]) for i in range(500)], labels, 80) == []


def test_overlaps_in_several_parts(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, 80, dtype=np.uint64)) for _ in range(9)] + [np.zeros(0, np.uint64)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for columns in (7, 8192):
        monkeypatch.setattr(minmax, "COLUMNS", columns)
        got = minmax.overlaps(sets)
        assert all(got[i][j] == want[i][j] for i in range(10) for j in range(10) if i != j)


def test_components_of_chains_and_stars(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + draw.randint(0, 40)) for _ in range(50)]
    links += [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(45)]
    draw.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    ids = sorted({x for a, b in links for x in (a, b) if a != b})
    group = grouped(range(300), links)
    first = {}
    for i in ids:
        first.setdefault(group[i], i)
    assert got == {i: first[group[i]] for i in ids}
