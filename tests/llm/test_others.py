"""Searches, archives, quality and mixture on odd rows and against brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimsift.llm import curves, mixing, pivots, quality, warc

VECTORS = "vec_id long, embedding array<double>, label int, score double"


@pytest.fixture(scope="module")
def vector_rows():
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).round(3).tolist(), 0, 0.0) for i in range(400)]
    rows += [(400 + i, rows[100][1], 0, 0.0) for i in range(60)] + [rows[7], rows[7]]
    rows += [(500, None, 0, 0.0), (550, [], 0, 0.0), (600, [0.0] * 6, 0, 0.0), (650, [1.0, None], 0, 0.0), (700, [math.nan] * 6, 0, 0.0)]
    return rows + [(None, [1.0] * 6, 0, 0.0), (750, [1.0, 2.0], 0, 0.0), (800, [math.inf] * 6, 0, 0.0)]


def valid(rows):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out[i] = np.array([*v, *[0.0] * (6 - len(v))])
    return out


def test_neighbours_against_all_pairs(spark, vector_rows):
    known = {i: v for i, v in valid(vector_rows).items() if v.any()}
    got = curves.neighbours(spark.createDataFrame(vector_rows, VECTORS), block=64).collect()
    ours, hits, total = {}, 0, 0
    for r in sorted(got, key=lambda r: r.rank):
        ours.setdefault(r.query_id, []).append(r)
    assert set(ours) == {i for i in known if i % 50 == 0}
    for q, rows in ours.items():
        cosine = {i: float(known[q] @ v / np.linalg.norm(known[q]) / np.linalg.norm(v)) for i, v in known.items() if i != q}
        best = sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cosine[r.vec_id]) < 1e-12 for r in rows)
        hits, total = hits + len(set(best) & {r.vec_id for r in rows}), total + 5
    assert hits >= 0.9 * total
    # Equal vectors are whole classes: the smallest ids come first.
    assert [r.vec_id for r in ours[100]] == [400, 401, 402, 403, 404]
    assert curves.neighbours(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_holds_when_blocks_are_a_small_share(spark):
    """Three blocks are a hundredth of the rows, and nothing is near anything."""
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(4800, 64))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    got = curves.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=16).collect()
    cosine = vecs[::50] @ vecs.T
    cosine[np.arange(96), np.arange(0, 4800, 50)] = -1
    best = {50 * q: set(np.argsort(-c)[:5].tolist()) for q, c in enumerate(cosine)}
    assert sum(r.vec_id in best[r.query_id] for r in got) >= 0.9 * 5 * 96


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_top_against_all_pairs(spark, vector_rows, scale):
    rows = [(i, v and [x if x is None else x * scale for x in v], a, b) for i, v, a, b in vector_rows]
    known = {i: [math.floor(64 * x) for x in v] for i, v in valid(rows).items()}
    got = pivots.top(spark.createDataFrame(rows, VECTORS), block=50, query_block=5).collect()
    clip = lambda v: max(-(1 << 63), min((1 << 63) - 1, v))
    want = []
    for q in known:
        if q % 20 == 0:
            scores = {i: clip(sum(a * b for a, b in zip(known[q], v))) for i, v in known.items() if i != q}
            best = sorted(scores, key=lambda i: (-scores[i], i))[:20]
            want += [(q, n, i, scores[i]) for n, i in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert pivots.top(spark.createDataFrame([], VECTORS)).collect() == []


def test_curve_is_continuous():
    side = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curves.hilbert(side, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(side[np.argsort(key)], axis=0)).sum(1) == 1).all()


PAGES = "page_id long, url string, html string, digest string, payload string"


def test_archive_gives_all_records_back(spark, tmp_path):
    big = "x é\r\n\r\n" * 40
    rows = [(5, "http://a/ü b", big), (3, None, big), (3, None, big), (None, "u", big), (7, "u", None), (8, "u", ""), (9, "u", "small"), (1, "v", "small")]
    pages = spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES)
    warc.write(pages, str(tmp_path / "a"))
    got = warc.read(spark, str(tmp_path / "a")).collect()
    found = sorted((r.page_id or 99, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in got)
    want = [(1, "response", None, "small"), (3, "response", None, big), (3, "revisit", 3, big), (5, "revisit", 3, big)]
    assert found == want + [(7, "response", None, ""), (8, "response", None, ""), (9, "response", None, "small"), (99, "revisit", 3, big)]
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 3
    warc.export(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    raw, n = b"".join(p.read_bytes() for p in (tmp_path / "b").glob("part-*")), 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")).split()[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        raw, n = rest[size + 4 :], n + 1
    assert n == len(rows)


def test_archive_notices_a_changed_payload(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "text", "d", "p")], PAGES), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.lit(b"other"))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "b/records"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, str(tmp_path / "b")).collect()


def test_empty_archive(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).collect() == []


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(0)
    counts, labels = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0])
    x = draw.normal(size=(8, 5))
    model = quality.fit(x, counts, labels)
    loss = lambda: float(-np.mean(labels * np.log(model.score(x, counts)) + (1 - labels) * np.log(1 - model.score(x, counts))))
    for name, gradient in model.gradients(x, counts, labels).items():
        place = tuple(0 for _ in gradient.shape) if np.ndim(gradient) else ()
        value = model.weights[name]
        model.weights[name] = np.array(value, dtype=float)
        model.weights[name][place] += 1e-5
        up = loss()
        model.weights[name][place] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(float(gradient[place]), abs=1e-5)
        model.weights[name] = value


def described_by_hand(text):
    """The features of all passages of a text, by loops over words."""
    kinds = [{" ": 0, "\t": 0, "\n": 0, "\x0b": 0, "\x0c": 0, "\r": 0}.get(chr(b), 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in b".," else 6 if b > 127 else 5) for b in text.encode()]
    data, spans, at = text.encode(), [], 0
    while at < len(data):
        if kinds[at] == 0:
            at += 1
            continue
        end = at
        while end < len(data) and kinds[end]:
            end += 1
        spans.append((at, end))
        at = end
    out = []
    for k in range(0, max(len(spans), 1), quality.PASSAGE_WORDS):
        words = spans[k : k + quality.PASSAGE_WORDS]
        row = np.zeros(quality.FEATURES)
        if words:
            a, b = words[0][0], words[-1][1]
            row[:7] = [kinds[a:b].count(kind) / (b - a) for kind in range(7)]
            lengths = [e - s for s, e in words]
            row[7], row[8] = np.mean(lengths) / 10, np.std(lengths) / 10
            texts = [data[s:e] for s, e in words]
            row[9] = sum(x == y for x, y in zip(texts, texts[1:])) / len(texts)
            row[10], row[11] = len(set(texts)) / len(texts), math.log1p(len(texts)) / 5
            for word in texts:
                name = sum((b + 1) * int(quality._POWERS[i & 63]) for i, b in enumerate(word)) % (1 << 64)
                name = (name ^ (name >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                row[12 + (name >> 58)] += 1 / len(texts)
        out.append(row)
    return out


def test_passages_against_loops(odd_rows):
    texts = [r[1] for r in odd_rows] + ["A, b. C7 #x é" * 30, " lead", "trail ", "same same same other"]
    x, counts = quality.passages(pa.array(texts))
    want = [described_by_hand(t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert np.allclose(x, np.concatenate(want), atol=1e-4)


def test_repeated_rows_of_a_document_count_once(spark):
    """One labelled id with very many rows does not push the others out, and reruns agree."""
    rows = [(2, f"copy {i}", "x") for i in range(300)] + [(i, f"text {i}", "x") for i in range(3, 40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 40)], "doc_id long, quality int")
    seen, fit = [], quality.fit
    quality.fit = lambda x, counts, y: seen.append((len(counts), y.sum(), x.sum())) or fit(x, counts, y)
    try:
        for parts in (1, 7):
            quality.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts), labels, sample=30)
    finally:
        quality.fit = fit
    known = [i for i in range(2, 40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0] == pytest.approx(seen[1]) and seen[0][0] == min(30, len(known))


def test_pipeline_of_odd_rows_and_of_none(spark, odd, odd_rows, none, tmp_path):
    """Every stage on odd rows, with and without labels, and on an empty table."""
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for kind, rows, labelled in (("odd", odd, [(i, i % 2) for i in range(12)]), ("none", none, [])):
        folder = str(tmp_path / kind)
        rows.select(names).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labelled, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        good = corpus_pipeline.good_documents(spark, docs, folder)
        assert good.columns == names and set(map(tuple, good.collect())) <= {(r[0], r[1], r[2], r[3], r[4]) for r in odd_rows}
        got = corpus_pipeline.run(spark, folder).collect()
        assert all(r.n_tokens == len(r.ids) for r in got) and (kind == "odd" or got == [])


def test_quality_is_learned_from_labels_alone(spark, odd, none):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + "#$"[i % 2] * (i % 3 == 0) for _ in range(draw.randint(30, 200))), int(i % 3 != 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).where("held_out").collect()
    assert len(got) > 60 and np.mean([r.predicted == r.truth for r in got]) > 0.95
    scored = quality.scored(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in scored) and len(scored) == odd.count()
    assert quality.scored(none, model).collect() == []
    plain = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.scored(odd, plain).collect()} == {0.5}


@pytest.mark.parametrize("pivot_count", [0, 8])
@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_batches_against_all_products(pivot_count, spread):
    """The best of every query whatever the pivots; where vectors lie in groups, few products are made."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(20, 16)) * 40
    table = np.floor(np.repeat(middle, 150, axis=0) + rng.normal(size=(3000, 16)) * 40 * spread).astype(np.int64)
    table[7] = table[8] = table[9]
    q = table[::50]
    length2 = float((table.astype(float) ** 2).sum(1).max())
    chosen = pivots.choose(np.column_stack([table, np.sqrt(length2 - (table**2).sum(1))]), pivot_count) if pivot_count else np.zeros((0, 17))
    tall = np.column_stack([table, np.sqrt(length2 - (table**2).sum(1))])
    far = np.linalg.norm(tall[:, None] - chosen, axis=2)
    q_far = np.linalg.norm(np.column_stack([q, np.zeros(len(q))])[:, None] - chosen, axis=2)
    ids = rng.permutation(3000) + 10
    least = np.full(len(q), -np.inf)
    row, found, scores, made = pivots.search_all(q, q_far, least, ids, table, far, length2, 21)
    for k, v in enumerate(q @ table.T):
        want = np.lexsort((ids, -v))[:21]
        assert found[row == k].tolist() == ids[want].tolist() and scores[row == k].tolist() == v[want].tolist()
    share = made / (len(q) * len(table))
    print(f"pivots {pivot_count}, spread {spread}: {share:.3f} of all products made")
    assert share < 0.9 if pivot_count and spread < 1 else share <= 1.0
    # A score to beat that nothing reaches.
    assert len(pivots.search_all(q, q_far, np.full(len(q), np.inf), ids, table, far, length2, 21)[0]) == 0


def test_share_of_products_on_the_given_vectors(spark, small):
    """What the table of pivots excludes there, as the README states it: next to nothing."""
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    table = np.floor(64 * np.array([r.embedding for r in rows], dtype=float))
    length2 = float((table**2).sum(1).max())
    tall = np.column_stack([table, np.sqrt(length2 - (table**2).sum(1))])
    chosen = pivots.choose(tall, pivots.PIVOTS)
    far = np.linalg.norm(tall[:, None] - chosen, axis=2)
    q = table[::20]
    q_far = np.linalg.norm(np.column_stack([q, np.zeros(len(q))])[:, None] - chosen, axis=2)
    made = pivots.search_all(q, q_far, np.full(len(q), -np.inf), np.arange(len(table)), table, far, length2, 21)[3]
    print(f"given vectors: {made / (len(q) * len(table)):.3f} of all products made")
    assert made <= len(q) * len(table)


def test_mix_of_odd_rows(odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    assert len(got) == len(odd_rows) and mixing.mix(none).collect() == []
    size = lambda t: len((t or "").encode().split())
    assert sorted(r.size for r in got) == sorted(size(r[1]) for r in odd_rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = {}
    for r in odd_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = {s for s in rest if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left, rest = left - sum(2 * sizes[s] for s in full), rest - full
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target[s]) for r in mine)
        # The quota is the target in whole words, and every word of it is taken.
        assert abs(sum(r.taken for r in mine) - target[s]) <= 0.5
        assert all((r.slot is None) == (r.taken == 0) and len(r.heads) <= 2 for r in mine)
    again = mixing.mix(odd.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixture_repeats_rows(odd, odd_rows, none):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.mixed(none).collect() == []
    copies = sum(len(r.heads) for r in mixing.mix(odd).collect())
    got = out.collect()
    assert len(got) == copies and all(r.text.strip() for r in got)
    assert {tuple(r) for r in got} <= set(odd_rows)


@pytest.mark.parametrize("slots", [8, 64, 1 << 18])
def test_small_sources_beside_a_hot_one_reach_their_quota(spark, monkeypatch, slots):
    """Forty sources of 50 words beside one of 40,000: a block may be larger than any of them."""
    monkeypatch.setattr(mixing, "SLOTS", slots)
    rows = [(i, "w " * 100, "hot") for i in range(400)] + [(1000 + i, "w " * 50, f"small{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    assert all(taken[f"small{i}"] == 100 for i in range(40)) and taken["hot"] == 1.5 * 42_000 - 4000
    got = mixing.mixed(docs).collect()
    assert sorted(r.doc_id for r in got if r.source != "hot") == sorted([*range(1000, 1040)] * 2)
    assert 59_000 <= 100 * sum(r.source == "hot" for r in got) < 59_100


def test_sources_are_mixed_evenly_in_slot_order(spark, monkeypatch):
    """Of any stretch of the output, each source has about its share."""
    monkeypatch.setattr(mixing, "SLOTS", 1 << 10)
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(3000)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "0.6180339" in plan
    got = [r.source for r in out.collect()]
    share = {s: got.count(s) / len(got) for s in "abc"}
    for n in range(300, len(got), 300):
        assert all(abs(got[:n].count(s) - share[s] * n) < 25 for s in "abc")


def test_every_block_has_one_slot(spark):
    quotas = [(1, 5), (2, 0), (3, 1000), (4, 1), (5, 64), (6, 9999), (7, 7)]
    sources = spark.createDataFrame(quotas, "place long, quota long")
    for block in (1, 7, 100_000):
        got = [(r.place, r.block, r.slot) for r in mixing.schedule(sources, block).collect()]
        assert sorted(x[:2] for x in got) == [(p, k) for p, q in quotas for k in range(-(-q // block))]
        assert len({x[2] for x in got}) == len(got)
        order = sorted(got, key=lambda x: x[2])
        assert all([b for q, b, _ in order if q == p] == list(range(-(-n // block))) for p, n in quotas)


def test_rows_that_differ_in_any_column_are_told_apart(spark):
    at = lambda n: datetime(2024, 1, 1, 0, 0, 0, n)
    rows = [(1, "a b", "s", at(1), None, 1), (1, "a b", "s", at(2), None, 1), (1, "a b", "s", at(1), "x", 1), (1, "a b", "s", at(1), None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key timestamp, _copies string, slot int")
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    # 24 words are wanted, half as much again: twelve rows, each of the four kinds at least twice.
    found = Counter(tuple(r) for r in got.collect())
    assert sum(found.values()) == 12 and len(found) == 4 and min(found.values()) >= 2


def test_pipeline_of_the_smallest_tables(spark):
    import corpus_pipeline

    docs = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns
    good = corpus_pipeline.good_documents(spark, docs, "/root/testdata/sf0.001")
    labels = corpus_pipeline.table(spark, "/root/testdata/sf0.001", "labels")
    judged = docs.join(labels, "doc_id").join(good.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left")
    assert judged.where("coalesce(kept, 0) = quality").count() >= 0.95 * judged.count()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
