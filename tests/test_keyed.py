"""Key decisions: every row is counted once, and repeating an upsert changes nothing."""

from contextlib import contextmanager

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from claimsift.operators import keyed, lookup, sketch

KEYS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))
BATCH = st.lists(st.tuples(KEYS, st.integers(0, 99)), max_size=25)
relaxed = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@contextmanager
def monkeypatched(most):
    """A bound below which a batch is broadcast; with -1 a sketch of it goes to the target."""
    kept, lookup.BROADCAST_ROWS = lookup.BROADCAST_ROWS, most
    try:
        yield
    finally:
        lookup.BROADCAST_ROWS = kept


@relaxed
@given(BATCH, st.sets(st.sampled_from(["a", "b", "x"])))
def test_intake_adds_up(spark, batch, stored):
    df = frame(spark, [(k, f"T{n}") for k, n in batch], "PatientID string, TransactionID string")
    target = frame(spark, [(k,) for k in stored], "PatientID string")
    for most in (-1, 1000):
        with monkeypatched(most):
            marked = keyed.mark_known(keyed.one_per_key(df, "PatientID", keyed.first_claim(df)), target, "PatientID")
        counts = keyed.intake_counts(marked).first()
        assert counts.total == len(batch)
        assert counts.new + counts.skipped + counts.in_batch_duplicates + counts.null_keys == counts.total
        assert counts.new == len({k for k, _ in batch if k} - stored)
        taken = {r.PatientID: r.TransactionID for r in keyed.accepted(marked).collect()}
        assert taken == {k: min(f"T{n}" for j, n in batch if j == k) for k in taken}


@relaxed
@given(BATCH, st.sets(st.sampled_from(["a", "b", "x"])))
def test_rows_are_new_or_skipped(spark, batch, stored):
    df = frame(spark, batch, "PatientID string, n int")
    target = frame(spark, [(k,) for k in stored], "PatientID string")
    new = [tuple(r) for r in keyed.new_rows(df, target, "PatientID").collect()]
    skipped = [tuple(r) for r in keyed.skipped_rows(df, target, "PatientID").collect()]
    assert sorted(new) == sorted(r for r in batch if r[0] and r[0] not in stored)
    assert sorted(skipped) == sorted(r for r in batch if r[0] in stored)


@relaxed
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 9)), st.dictionaries(st.sampled_from("abxy"), st.one_of(st.none(), st.integers(0, 9))))
def test_merge_replaces_inserts_and_repeats(spark, old, new):
    target = frame(spark, [(k, v, f"kept {k}") for k, v in old.items()], "id string, v int, note string")
    incoming = frame(spark, list(new.items()), "id string, v int")
    expected = {k: (v, f"kept {k}") for k, v in old.items()}
    expected.update({k: (v, f"kept {k}" if k in old else "fresh") for k, v in new.items()})
    once = keyed.merged(target, incoming, "id", {"note": F.lit("fresh")})
    twice = keyed.merged(once, incoming, "id", {"note": F.lit("fresh")})
    for result in (once, twice):
        rows = result.collect()
        assert len(rows) == len(expected)
        assert {r.id: (r.v, r.note) for r in rows} == expected


def test_riskiest_row_wins(spark):
    rows = [("a", "T2", 0.6), ("a", "T1", 0.9), ("a", "T0", 0.9), ("b", "T3", None), ("b", "T4", 0.1)]
    df = frame(spark, rows, "PatientID string, TransactionID string, Risk_Score double")
    got = {r.PatientID: r.TransactionID for r in keyed.one_per_key(df, "PatientID", keyed.riskiest_claim(df)).collect()}
    assert got == {"a": "T0", "b": "T4"}


def test_numeric_keys_compare_as_text(spark):
    batch = frame(spark, [(1,), (2,)], "k long")
    target = frame(spark, [("1",)], "k string")
    assert [r.k for r in keyed.new_rows(batch, target, "k").collect()] == [2]


def test_status_updates(spark):
    target = frame(spark, [("a", "Open"), ("b", None), ("c", "Open")], "PatientID string, Investigation_Status string")
    updates = frame(
        spark,
        [("a", "Closed", "2024-01-02"), ("a", "Zzz", "2024-01-01"), ("b", "Open", "2024-01-01"), ("z", "Open", "2024-01-01")],
        "PatientID string, Investigation_Status string, updated_at string",
    )
    got = {r.PatientID: r.Investigation_Status for r in keyed.with_status(target, updates).collect()}
    assert got == {"a": "Closed", "b": "Open", "c": "Open"}


def test_a_sketch_lets_all_its_keys_through_and_few_others(spark):
    keys = spark.range(0, 40_000, 4).select(F.concat(F.lit("k"), "id").alias("key"))
    table = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    made = sketch.sketch(keys, "key", 10_000)
    passed = sketch.members(table, "key", made, 10_000)
    got = {r.id for r in passed.select("id").collect()}
    assert set(range(0, 40_000, 4)) <= got
    assert len(got) - 10_000 < 0.02 * 30_000
    # The table meets the sketch where it is read: nothing of it is shuffled.
    plan = passed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == sketch.HASHES
    assert "hashpartitioning(key" not in plan and "hashpartitioning(id" not in plan
    assert sketch.sketch_bits(10**12) == sketch.MOST_BITS and sketch.sketch_bits(0) == sketch.LEAST_BITS


def test_beyond_the_bound_only_what_passes_the_sketch_is_shuffled(spark):
    """The join above the bound: below each shuffle of the target stand the sketch's joins."""
    wanted = spark.range(100).select(F.concat(F.lit("k"), "id").alias("_key"))
    target = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    with monkeypatched(10):
        found = keyed.found_keys(target, "key", wanted, 100)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["_key"] for r in found.collect()) == sorted(f"k{i}" for i in range(100))
    semi = plan.split("LeftSemi")[1]
    assert plan.count("bit_get") >= sketch.HASHES and semi.count("bitmap_construct_agg") == sketch.HASHES
    with monkeypatched(1000):
        plain = keyed.found_keys(target, "key", wanted, 100)
        assert "bit_get" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert plain.count() == 100


def test_without_a_table_every_key_is_new(spark):
    df = frame(spark, [("a", "T1"), ("a", "T2"), ("b", "T3"), (None, "T4")], "PatientID string, TransactionID string")
    marked = keyed.mark_known(keyed.one_per_key(df, "PatientID", keyed.first_claim(df)), None, "PatientID")
    assert marked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert keyed.intake_counts(marked).first().asDict() == {"total": 4, "new": 2, "skipped": 0, "in_batch_duplicates": 1, "null_keys": 1}
    assert {(r.PatientID, r.TransactionID) for r in keyed.accepted(marked).collect()} == {("a", "T1"), ("b", "T3")}


def test_marks_stay_when_the_table_changes(spark, tmp_path):
    """The keys found in the table are written: marks read after an append are those from before it."""
    path = str(tmp_path / "held")
    frame(spark, [("a",)], "PatientID string").write.parquet(path)
    df = frame(spark, [("a", "T1"), ("b", "T2")], "PatientID string, TransactionID string")
    target = spark.read.parquet(path)
    marked = keyed.mark_known(keyed.one_per_key(df, "PatientID", keyed.first_claim(df)), target, "PatientID")
    assert path not in "".join(marked.inputFiles())
    assert {r.PatientID: r._known for r in marked.collect()} == {"a": True, "b": False}


@relaxed
@given(BATCH, st.dictionaries(st.sampled_from(["a", "b", "x"]), st.booleans()))
def test_marks_of_keys_alone_are_those_of_rows(spark, batch, stored):
    df = frame(spark, [(k, f"T{n}", n) for k, n in batch], "PatientID string, TransactionID string, n int")
    target = frame(spark, [*stored.items(), (None, True)], "PatientID string, mine boolean")
    order, own = keyed.first_claim(df), F.col("mine")
    whole = keyed.mark_known(keyed.one_per_key(df, "PatientID", order), target, "PatientID", own)
    thin = keyed.mark_keys(df, target, "PatientID", own)
    assert keyed.intake_counts(thin).first() == keyed.intake_counts(whole).first()
    want = sorted(tuple(r) for r in keyed.accepted(whole).collect())
    for most in (-1, 1000):
        with monkeypatched(most):
            assert sorted(tuple(r) for r in keyed.fresh_rows(df, thin, "PatientID", order).select(df.columns).collect()) == want


def test_a_value_is_carried_once_to_its_key(spark):
    """Neither a text key nor what the order has is in the row beside it; a key of another type is."""
    rows = [("7", "T2", 1), ("7", "T1", None), ("7", "T1", 5), (None, "T0", 3), ("8", None, 4)]
    df = frame(spark, rows, "PatientID string, TransactionID string, n int")
    one = keyed.one_per_key(df, "PatientID", keyed.first_claim(df))
    carried = one._jdf.queryExecution().optimizedPlan().toString().split("min(struct(")[1].split("_first")[0]
    assert "PatientID#" not in carried and carried.count("TransactionID#") == 1 and carried.count("n#") == 1
    assert one.columns == ["_key", *df.columns, "_copies"]
    want = {(None, None, "T0", 3, 1), ("7", "7", "T1", None, 3), ("8", "8", None, 4, 1)}
    assert {tuple(r) for r in one.collect()} == want
    numbered = df.withColumn("PatientID", F.col("PatientID").cast("long"))
    other = keyed.one_per_key(numbered, "PatientID", keyed.first_claim(df))
    assert other.schema["PatientID"].dataType.typeName() == "long"
    assert {tuple(r) for r in other.collect()} == {(k, None if p is None else int(p), t, n, c) for k, p, t, n, c in want}
    assert {tuple(r) for r in keyed.one_per_key(df.select("PatientID"), "PatientID", []).collect()} == {(None, None, 1), ("7", "7", 3), ("8", "8", 1)}
