"""WARC archives that store every payload once, under its SHA-256.

An archive is two tables: ``payloads`` (digest, payload) and ``records`` (the
exact bytes of each record's headers, the digest of its payload, and what is
needed to find it). A record is its headers, then its payload, if it is a
response; reading joins the two tables on the digest, after the stored bytes
have been hashed again and found to be what the digest says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimsift.llm.common import new_folder, table

# Fixed value of the contract: smaller payloads are never revisits.
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n"


def _lines(*lines: Column) -> Column:
    return F.concat(*[F.concat(line, F.lit(_END)) for line in lines], F.lit(_END))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _record_id(page: Column, url: Column, copy: Column) -> Column:
    """A name of its own for each record, made from what it holds."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.md5(_text(url).cast("binary")), F.lit(":"), copy.cast("string"))


def records(pages: DataFrame, least: int = LEAST_BYTES, date: str = DATE) -> DataFrame:
    """The record of each row of ``pages`` (page_id, url, html), without payload.

    The payload is the html in UTF-8, empty where it is null. Of records with
    equal payloads of ``least`` bytes or more the first is a response and the
    others are revisits that refer to it: the one with the smallest page_id,
    then url (nulls last), and of equal rows any. A url goes into the headers
    percent-encoded; one that is null gives no ``WARC-Target-URI``.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"),
    )
    # Equal rows are counted, then numbered.
    rows = rows.groupBy("page_id", "url", "digest", "size").agg(F.count("*").alias("copies"))
    turn = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.col("url").isNull().alias("c"), F.col("url").alias("d"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(turn).alias("first"))
    first = first.select(F.col("digest").alias("_digest"), "first")
    rows = rows.join(first, F.col("digest") == F.col("_digest"), "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    response = F.col("first").isNull() | ((F.col("copy") == 0) & (F.col("first") == turn))
    zero = F.lit(0).cast("long")
    first_id = _record_id(F.col("first.b"), F.col("first.d"), zero)
    # Spaces and control characters would break the header.
    url = F.replace(F.url_encode(F.col("url")), F.lit("+"), F.lit("%20"))
    for plain, coded in ((":", "%3A"), ("/", "%2F"), ("?", "%3F"), ("=", "%3D"), ("&", "%26"), ("#", "%23")):
        url = F.replace(url, F.lit(coded), F.lit(plain))
    rows = rows.withColumns(
        {
            "record_type": F.when(response, "response").otherwise("revisit"),
            "refers_to": F.when(~response, F.col("first.b")),
            "record_id": _record_id(F.col("page_id"), F.col("url"), F.col("copy")),
            "http": F.concat(
                F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                F.col("size").cast("string"),
                F.lit(_END * 2),
            ),
        }
    )
    held = F.when(response, F.col("size")).otherwise(zero)
    optional = lambda name, value: F.coalesce(F.concat(F.lit(name), value, F.lit(_END)), F.lit(""))
    warc = F.concat(
        F.lit(f"WARC/1.1{_END}WARC-Type: "),
        F.col("record_type"),
        F.concat(F.lit(f"{_END}WARC-Record-ID: <"), F.col("record_id"), F.lit(f">{_END}WARC-Date: {date}{_END}")),
        optional("WARC-Target-URI: ", url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(_END)),
        optional("WARC-Refers-To: ", F.when(~response, F.concat(F.lit("<"), first_id, F.lit(">")))),
        optional("WARC-Profile: ", F.when(~response, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http; msgtype=response{_END}Content-Length: "),
        (F.octet_length("http") + held).cast("string"),
        F.lit(_END * 2),
    )
    return rows.select(
        "page_id",
        "record_id",
        "record_type",
        "refers_to",
        "digest",
        F.concat(warc, F.col("http")).cast("binary").alias("headers"),
    )


def write(pages: DataFrame, folder: str, least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write the archive of ``pages`` into ``folder``: headers and payloads apart.

    Payloads are reduced to one for each digest before and after the shuffle.
    """
    records(pages, least, date).write.option("compression", "zstd").parquet(f"{folder}/records")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    payloads = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    once = payloads.dropDuplicates(["digest"])
    once.write.option("compression", "zstd").parquet(f"{folder}/payloads")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """``(digest, payload, payload_bytes, payload_digest)``: the stored payloads, hashed
    anew. One that is not what its digest says fails the job."""
    stored = spark.read.parquet(f"{folder}/payloads")
    found = F.sha2("payload", 256)
    checked = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))))
    return stored.select("digest", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Each record of the archive joined with its payload.

    What the headers say comes from their bytes: type, page and reference.
    ``payload`` and ``record`` (the whole record as a WARC file has it) are read
    from the store only where they are selected.
    """
    stored = spark.read.parquet(f"{folder}/records").select("headers")
    text = F.col("headers").cast("string")
    line = lambda name, value: F.nullif(F.regexp_extract(text, f"\n{name}: {value}\r\n", 1), F.lit(""))
    page = lambda column: F.when(column != "none", column).cast("long")
    parsed = stored.select(
        page(line("WARC-Record-ID", "<urn:page:([^:>]*):[^>]*>")).alias("page_id"),
        line("WARC-Record-ID", "<([^>]*)>").alias("record_id"),
        line("WARC-Type", "([a-z]+)").alias("record_type"),
        page(line("WARC-Refers-To", "<urn:page:([^:>]*):[^>]*>")).alias("refers_to"),
        line("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"),
        "headers",
    )
    # A digest that very many records share is split at run time.
    joined = parsed.join(verified(spark, folder), "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("headers", body, F.lit((_END * 2).encode()))).drop("digest")


def export(spark: SparkSession, folder: str, target: str) -> None:
    """Write the archive as plain WARC files: every record, then two line ends."""
    whole = read(spark, folder).select(F.col("record").cast("string").alias("value"))
    # The writer puts the two line ends that close a record.
    closed = F.expr(f"substring(value, 1, char_length(value) - {2 * len(_END)})")
    whole.select(closed.alias("value")).write.option("lineSep", _END * 2).text(target)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op2: all pages archived and read back."""
    place = new_folder(spark, "archive")
    write(table(spark, folder, "pages"), place)
    return read(spark, place).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH rows AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         row_number() OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST, url NULLS LAST) AS n,
         first_value(page_id) OVER (PARTITION BY sha256(coalesce(html, '')) ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id
  FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n = 1 OR payload_bytes < {LEAST_BYTES} THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 AND payload_bytes >= {LEAST_BYTES} THEN first_id END AS refers_to
FROM rows
"""
