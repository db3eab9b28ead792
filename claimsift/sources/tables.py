"""Stored tables: claims, upload sessions, audit log, detected frauds and ingested batches.

A table is a parquet folder partitioned by a hash bucket of its key. Appends add
files. An upsert reads and rewrites only the buckets that its keys fall into,
by Spark's dynamic partition overwrite. One writer at a time.

A frame read before an upsert goes on serving the buckets that were left alone;
where it comes to a file that was replaced, Spark says that the file is gone,
and the table has to be read anew. A read during the commit of an upsert may
find some of its buckets renewed and others not yet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from claimsift.functions.text import user_id_of
from claimsift.operators import keyed
from claimsift.operators.summaries import for_user, fraud_queue
from claimsift.schema import FRAUD_COLUMNS, TABLE_DEFAULTS, TABLE_KEYS, TABLES, has
from claimsift.session import COMPRESSION, materialize
from claimsift.sources.files import path_exists, read_claims_csv


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns the frame has."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def stamp_user(df: DataFrame, user_id: str | None) -> DataFrame:
    """The user on every row, when one is given."""
    return df.withColumn("user_id", F.lit(user_id)) if user_id else df


def to_fraud_schema(df: DataFrame, cost_col: str | None) -> DataFrame:
    """Cost and diagnosis under the names of the fraud table."""
    if cost_col and cost_col != "Final_Billed_Amount":
        df = df.withColumn("Final_Billed_Amount", F.col(cost_col))
    if "Primary_Diagnosis" not in df.columns and "Disease" in df.columns:
        df = df.withColumn("Primary_Diagnosis", F.col("Disease"))
    return df


def defaults_of(table: str, now: Column) -> dict[str, Column]:
    """What a table's columns hold when an insert does not say."""
    return {c: now if v == "now" else F.lit(v) for c, v in TABLE_DEFAULTS[table].items()}


def layout_values(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> dict[str, Column]:
    """A table's columns as a frame and the defaults give them."""

    def value(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`").cast(field.dataType) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            column = F.coalesce(column, defaults[field.name])
        return column.cast(field.dataType)

    return {f.name: value(f) for f in schema.fields}


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """Rows in a table's layout; missing values take the defaults, other columns fall off."""
    return df.select(*[value.alias(name) for name, value in layout_values(df, schema, defaults).items()])


def session_rows(df: DataFrame, now: Column) -> DataFrame:
    """Upload sessions ready to append, in UTC time."""
    if not has(df, "user_id"):
        df = df.withColumn("user_id", user_id_of(F.col("uid")))
    return conform(df, TABLES["upload_sessions"], defaults_of("upload_sessions", now))


def audit_rows(df: DataFrame, now: Column) -> DataFrame:
    """Log entries ready to append; missing texts are empty, amounts 0."""
    if not has(df, "user_id"):
        df = df.withColumn("user_id", user_id_of(F.col("uid")))
    return conform(df, TABLES["audit_log"], defaults_of("audit_log", now))


@dataclass(frozen=True)
class ClaimStore:
    """The tables under one folder.

    ``claim_key`` is the key of the claims table. TransactionID keeps all
    claims; the layout's own key, PatientID, keeps one claim per patient.
    ``buckets`` is part of a table's layout: every store on a folder needs the
    same. Choose it so that a bucket is some hundred megabytes.
    """

    spark: SparkSession
    root: str
    claim_key: str = "TransactionID"
    buckets: int = 64

    def key(self, table: str) -> str:
        return self.claim_key if table == "claims" else TABLE_KEYS[table]

    def schema(self, table: str) -> T.StructType:
        layout = TABLES[table]
        if table != "claims":
            return layout
        named = [] if self.claim_key in layout.names else [T.StructField(self.claim_key, T.StringType())]
        # The batch that brought a claim in, by which a batch run again knows its own rows.
        return T.StructType([*named, *layout.fields, T.StructField("batch_id", T.StringType())])

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    @property
    def bucket(self) -> str:
        """The partition column; its name holds the number of buckets."""
        return f"bucket_of_{self.buckets}"

    def bucket_of(self, key: Column, *spread: Column) -> Column:
        """The bucket of a key; rows without one are spread by other columns."""
        text = key.cast("string")
        hashed = F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.lit(0), *spread))
        return F.pmod(hashed, F.lit(self.buckets)).cast("int")

    def bucketed(self, table: str) -> DataFrame:
        """All rows of a table with their bucket."""
        layout = T.StructType([*self.schema(table).fields, T.StructField(self.bucket, T.IntegerType())])
        if not path_exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], layout)
        df = self.spark.read.schema(layout).parquet(self.path(table))
        if df.columns != layout.names:
            raise ValueError(f"{self.path(table)} is not laid out in {self.buckets} buckets")
        return df

    def in_buckets(self, table: str, touched: list[int]) -> DataFrame:
        """The rows of some buckets; the others' files are not listed for reading."""
        return self.bucketed(table).where(F.col(self.bucket).isin(touched)).drop(self.bucket)

    def read(self, table: str, user_id: str | None = None) -> DataFrame:
        """All rows, or one user's where the table has such a column."""
        return for_user(self.bucketed(table).drop(self.bucket), user_id)

    def write(self, table: str, df: DataFrame, mode: str, defaults: dict[str, Column] | None = None) -> None:
        """Write rows in the table's layout to their buckets.

        Each bucket's rows are brought together, a large one's in several tasks
        and small ones' in one, so that files are few and none is too large.
        Within a file rows are in the order of their users: whoever reads one
        user's rows skips the row groups and pages of all others.
        With ``defaults`` the rows are brought into the layout on the way, so
        that what the defaults fill in is not shuffled.
        """
        names = self.schema(table).names
        values = {c: F.col(f"`{c}`") for c in names} if defaults is None else layout_values(df, self.schema(table), defaults)
        rows = df.withColumn(self.bucket, self.bucket_of(values[self.key(table)], *values.values()))
        rows = rows.hint("rebalance", F.col(self.bucket)).select(*[v.alias(c) for c, v in values.items()], self.bucket)
        clustered = [self.bucket, *[c for c in ("user_id", "uid") if c in names]]
        writer = rows.sortWithinPartitions(*clustered).write.partitionBy(self.bucket).mode(mode)
        writer.option("partitionOverwriteMode", "dynamic").option("compression", COMPRESSION).parquet(self.path(table))

    def append(self, table: str, df: DataFrame, defaults: dict[str, Column] | None = None) -> None:
        """Add rows in the table's layout, or with ``defaults`` rows to be brought into it."""
        self.write(table, df, "append", defaults)

    def append_new(
        self,
        table: str,
        df: DataFrame,
        now: Column,
        key: str | None = None,
        user_id: str | None = None,
        batch_id: str | None = None,
        stored: bool = False,
    ) -> dict[str, int]:
        """Append the rows whose key the table lacks; known keys are left alone.

        The decision is written to the shared folder first, so counting and
        writing agree even when tasks are retried. Repeating a batch adds nothing.
        With ``batch_id`` claims keep the name of the batch that brought them:
        a batch run again, also after an append that ended early, adds what is
        missing and has the counts of its first run. ``stored`` says that ``df``
        is read off files, which stay as they are and can be read again: then
        the decision is made of its keys alone, and only new rows are carried.
        """
        key = key or self.key(table)
        df = stamp_user(df, user_id)
        layout, defaults = self.schema(table), defaults_of(table, now)
        if batch_id is not None and "batch_id" in layout.names:
            df = df.withColumn("batch_id", F.lit(batch_id))
        if key not in df.columns:
            rows = materialize(conform(df, layout, defaults), "intake")
            self.append(table, rows)
            total = rows.count()
            return {"total": total, "new": total, "skipped": 0, "in_batch_duplicates": 0, "null_keys": 0}
        wanted = [c for c in df.columns if c in layout.names or c in (key, "TransactionID")]
        df, order = df.select(*[F.col(f"`{c}`") for c in wanted]), keyed.first_claim(df)
        own = F.col("batch_id") == F.lit(batch_id) if batch_id is not None and "batch_id" in layout.names else None
        held = self.read(table) if path_exists(self.spark, self.path(table)) else None
        if stored:
            given = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(f"`{key}`").isNull()).alias("null_keys")).first()
            if held is None:
                return self.begin(table, keyed.one_per_key(df, key, order), given.total, given.null_keys, defaults)
            if keyed.is_near(held, given.total):
                marked = keyed.mark_keys(df, held, key, own)
                counts = keyed.intake_counts(marked).first().asDict()
                if counts["new"]:
                    self.append(table, keyed.fresh_rows(df, marked, key, order), defaults)
                return counts
        reduced = keyed.one_per_key(df, key, order)
        # What the table does not hold has done its part, and a text key is in ``_key``.
        spared = [c for c in wanted if c not in layout.names or (c == key and keyed.is_text(df, key))]
        marked = keyed.mark_known(reduced.drop(*spared), held, key, own)
        counts = keyed.intake_counts(marked).first().asDict()
        if counts["new"]:
            fresh = keyed.accepted(marked.withColumn(key, F.col("_key")) if key in spared else marked)
            self.append(table, fresh, defaults)
        return counts

    def begin(self, table: str, reduced: DataFrame, total: int, null_keys: int, defaults: dict[str, Column]) -> dict[str, int]:
        """The first rows of a table; what it holds then are the new ones."""
        if total > null_keys:
            self.append(table, reduced.where(F.col("_key").isNotNull()), defaults)
        new = self.read(table).count()
        return {"total": total, "new": new, "skipped": 0, "in_batch_duplicates": total - null_keys - new, "null_keys": null_keys}

    def touched(self, df: DataFrame, key: Column) -> list[int]:
        """The buckets of the keys of ``df``: at most ``buckets`` numbers."""
        return [r[0] for r in df.where(key.isNotNull()).select(self.bucket_of(key)).distinct().collect()]

    def upsert(
        self, table: str, df: DataFrame, now: Column, key: str | None = None, user_id: str | None = None, stored: bool = False
    ) -> int:
        """Insert or replace by key; columns the rows lack stay untouched.

        Of several rows of one key the riskiest counts. Only the buckets of the
        keys are read and rewritten. Returns the keys written. ``stored`` says
        that ``df`` is read off files and can be read again: then its keys alone
        tell the buckets, and its rows are shuffled once, to meet the table's.
        """
        key = key or self.key(table)
        if key != self.key(table):
            raise ValueError(f"{table} is laid out by {self.key(table)}, not by {key}")
        wanted = dict.fromkeys([key, *self.schema(table).names, "TransactionID", "Risk_Score"])
        df = select_existing(stamp_user(df, user_id), list(wanted))
        reduced = keyed.one_per_key(df, key, keyed.riskiest_claim(df)).where(F.col("_key").isNotNull())
        incoming = select_existing(reduced, self.schema(table).names)
        if stored:
            keys = keyed.keys_of(df, key).groupBy(self.bucket_of(F.col("_key")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()
            written, touched = sum(r.n for r in keys), [r.bucket for r in keys]
        else:
            incoming = materialize(incoming, "upsert")
            written = incoming.count()
            touched = self.touched(incoming, F.col(key)) if written else []
        if written:
            target = self.in_buckets(table, touched)
            self.write(table, keyed.merged(target, incoming, key, defaults_of(table, now)), "overwrite")
        return written

    def upsert_detected_frauds(
        self, df: DataFrame, now: Column, cost_col: str | None, user_id: str | None = None, stored: bool = False
    ) -> int:
        """Cases in the fraud table's columns, one per patient, upserted (``stored``: see ``upsert``)."""
        cases = to_fraud_schema(stamp_user(df, user_id), cost_col)
        kept = select_existing(cases, [*FRAUD_COLUMNS, "TransactionID"])
        return self.upsert("detected_frauds", kept, now, stored=stored)

    def log_upload_sessions(self, df: DataFrame, now: Column) -> int:
        """Append session rows; one that is logged already is not logged again."""
        return self.append_new("upload_sessions", session_rows(df, now), now)["new"]

    def log_audit_events(self, df: DataFrame, now: Column) -> int:
        """Append log entries; one that is logged already is not logged again."""
        return self.append_new("audit_log", audit_rows(df, now), now)["new"]

    def update_claim_status(self, updates: DataFrame, now: Column, batch_id: str, user_id: str | None = None) -> None:
        """Investigation status on claims and cases, with one log entry per update.

        ``updates`` has PatientID and Investigation_Status; unknown patients
        are logged, as before, but not inserted. Only buckets that hold one of
        the patients are rewritten; a table laid out by another key is searched
        for them, which reads two of its columns.
        """
        updates = materialize(updates, "status")
        patients = updates.select(F.col("PatientID").cast("string").alias("PatientID")).distinct()
        for table in ("claims", "detected_frauds"):
            holders = self.bucketed(table).select("PatientID", self.bucket)
            if self.key(table) == "PatientID":
                holders = holders.where(F.col(self.bucket).isin(self.touched(patients, F.col("PatientID"))))
            found = holders.join(patients, "PatientID", "left_semi").select(self.bucket).distinct()
            touched = [r[0] for r in found.collect()]
            if touched:
                self.write(table, keyed.with_status(self.in_buckets(table, touched), updates), "overwrite")
        self.log_audit_events(status_events(updates, batch_id, user_id), now)

    def record_batch(self, batch_id: str, counts: dict[str, int], now: Column) -> None:
        """The counts of an ingested batch, once however often it is run."""
        row = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), *[F.lit(n).alias(c) for c, n in counts.items()])
        held = self.in_buckets("ingest_batches", self.touched(row, F.col("batch_id")))
        if not held.where(F.col("batch_id") == batch_id).head(1):
            self.append("ingest_batches", conform(row, TABLES["ingest_batches"], defaults_of("ingest_batches", now)))

    def read_detected_frauds(self, user_id: str | None = None) -> DataFrame:
        """Cases by falling risk, of one user or all."""
        return fraud_queue(self.read("detected_frauds", user_id))

    def sync_csv(self, path: str, now: Column, user_id: str | None = None) -> tuple[bool, str]:
        """A CSV file's new rows into the claims table, with a status line."""
        if not path_exists(self.spark, path):
            return False, f"File not found: {path}"
        claims = read_claims_csv(self.spark, path)
        if claims.isEmpty():
            return False, "CSV file is empty."
        counts = self.append_new("claims", claims, now, user_id=user_id, stored=True)
        return True, f"✅ Sync Complete: {counts['new']} new rows added, {counts['skipped']} skipped."


def status_events(updates: DataFrame, batch_id: str, user_id: str | None) -> DataFrame:
    """The log entries of a set of status updates."""
    patient, status = F.col("PatientID"), F.col("Investigation_Status")
    description = F.concat(F.lit("Status for Patient "), patient, F.lit(" changed to '"), status, F.lit("'."))
    return updates.select(
        F.concat_ws("|", F.lit(batch_id), patient, status).alias("id"),
        F.lit(user_id).cast("string").alias("uid"),
        F.lit("Status Update").alias("action"),
        description.alias("description"),
        patient.alias("patient_id"),
    )
