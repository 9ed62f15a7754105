"""WARC derivatives: response records become linked metadata records and plain-text conversion records.

Responses come from WARC files (``read_warc``), with their own ids, dates, headers and digests, or from a table of pages
(``responses``), which lacks some of these: columns of the names record_id, warc_date, http_headers and payload_digest are
taken where the table has them and hold a value, and are made else. Made ids follow from the url, the page id and the
payload, so reruns give the same ids and repeated rows repeat theirs.

A null page or an empty one is a response with an empty payload; its conversion has an empty block. A comment, a script, a
style or a tag that is never closed goes on to the end of the page. Every pattern reads a page once, whatever it holds.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WARC_DATE = "2024-01-01T00:00:00Z"
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: What stands between two records: the end of one and the start of the next one's first line.
RECORD_END = "\r\n\r\nWARC/1."
#: Elements that end a line of text.
_BLOCK = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|header|footer|nav|blockquote|pre|title|form|hr|dd|dt|dl"
#: Pattern and replacement in turn; the same in Java's and in RE2's syntax.
TEXT_STEPS = [
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<script\b[^>]*(?:>.*?(?:</script\s*(?:>|\z)|\z)|\z)", " "),
    (r"(?is)<style\b[^>]*(?:>.*?(?:</style\s*(?:>|\z)|\z)|\z)", " "),
    (rf"(?i)</?(?:{_BLOCK})\b[^>]*(?:>|\z)", "\n"),
    (r"<[/!a-zA-Z][^>]*(?:>|\z)", ""),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    (r"[ \t\r\f\x0B]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+", ""),
    (r"[ \n]+$", ""),
]


def plain_text(html):
    out = F.coalesce(html, F.lit(""))
    for pattern, to in TEXT_STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    return out


def record_id(*parts):
    h = F.md5(F.concat_ws("\x1f", *parts))
    at = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in at)), F.lit(">"))


def digest(block):
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages: page_id, record_id, target_uri, warc_date, http_headers, payload,
    payload_digest."""
    payload, uri = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    given = lambda name: F.col(name).cast("string") if name in pages.columns else F.lit(None).cast("string")
    own = [given(c).alias(f"_{c}") for c in ("record_id", "warc_date", "http_headers", "payload_digest")]
    base = pages.select(F.col("page_id").cast("long"), uri.alias("target_uri"), payload.alias("payload"), *own)
    base = base.withColumn("payload_digest", F.coalesce("_payload_digest", digest(F.col("payload"))))
    rid = record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "payload_digest")
    return base.select(
        "page_id", F.coalesce("_record_id", rid).alias("record_id"), "target_uri", F.coalesce("_warc_date", F.lit(WARC_DATE)).alias("warc_date"),
        F.coalesce("_http_headers", F.lit(HTTP_HEADERS)).alias("http_headers"), "payload", "payload_digest",
    )


def _field(head, name: str):
    """The value of a header field, null where it is not there."""
    return F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or gzip by member, as ``responses`` gives them (page_id is null), and
    whole: whether the record is as long as its header says. Spark's text reader cuts files at the ends of records, so
    a plain file is read by many tasks and no file is held in memory; a record that holds such an end itself is cut
    there, and whole is false. Payloads are taken as UTF-8 whatever their headers say; bytes that are not are replaced."""
    cut = spark.read.option("lineSep", RECORD_END).text(path)
    at = lambda text: F.instr(text, "\r\n\r\n")
    parts = cut.select("value", at(F.col("value")).alias("_n")).where("_n > 0").select(F.expr("substring(value, 1, _n + 1)").alias("_head"), F.expr("substring(value, _n + 4)").alias("_body"))
    parts = parts.where(F.lower(_field(F.col("_head"), "WARC-Type")) == "response").withColumn("_size", _field(F.col("_head"), "Content-Length").cast("long"))
    last = F.expr("octet_length(_body) = _size + 4")  # a file's last record has its end still
    parts = parts.withColumn("_body", F.when(last, F.expr("left(_body, length(_body) - 4)")).otherwise(F.col("_body"))).withColumn("_b", at(F.col("_body")))
    made = parts.select("_head", "_body", "_size", F.expr("if(_b > 0, substring(_body, 1, _b + 3), '')").alias("http_headers"), F.expr("if(_b > 0, substring(_body, _b + 4), _body)").alias("payload"))
    of = lambda name: _field(F.col("_head"), name)
    return made.select(
        F.lit(None).cast("long").alias("page_id"), of("WARC-Record-ID").alias("record_id"), F.coalesce(of("WARC-Target-URI"), F.lit("")).alias("target_uri"), of("WARC-Date").alias("warc_date"), "http_headers",
        F.make_valid_utf8("payload").alias("payload"), F.coalesce(of("WARC-Payload-Digest"), digest(F.col("payload"))).alias("payload_digest"), F.coalesce(F.octet_length("_body") == F.col("_size"), F.lit(False)).alias("whole"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its conversion, each with an id of its own, refers_to the response, the
    source's target, date, headers and payload digest, and its own block with digest and length in bytes. No row moves
    between tasks."""
    src = records.withColumn("_text", plain_text(F.col("payload")))
    fields = F.concat(
        F.lit("fetched-length: "), F.octet_length("payload").cast("string"), F.lit("\r\nhttp-status: "), F.regexp_extract("http_headers", r"^HTTP/\S+ (\d+)", 1),
        F.lit("\r\nsource-digest: "), F.col("payload_digest"), F.lit("\r\ntext-digest: "), digest(F.col("_text")), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block")),
    )
    out = src.withColumn("_d", F.explode(kinds))
    block = F.col("_d.block")
    return out.select(
        "page_id", F.col("_d.type").alias("warc_type"), record_id(F.col("_d.type"), "record_id").alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "warc_date", F.col("_d.content_type").alias("content_type"), F.col("http_headers").alias("source_headers"),
        F.col("payload_digest").alias("source_digest"), digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
    )


def _members(batches):
    """Each record as one gzip member, as the WARC format asks, so that a file can be read from any member on."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            body = (r["block"] or "").encode("utf-8", "surrogatepass")
            head = [
                "WARC/1.1", f"WARC-Type: {r['warc_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Refers-To: {r['refers_to']}", f"WARC-Target-URI: {r['target_uri']}",
                f"WARC-Date: {r['warc_date']}", f"WARC-Block-Digest: {r['block_digest']}", f"WARC-Source-Digest: {r['source_digest']}", f"Content-Type: {r['content_type']}", f"Content-Length: {len(body)}",
            ]
            out.append(gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", mtime=0))
        yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(out, pa.binary())], ["record_id", "member"])


def warc_members(derived: DataFrame) -> DataFrame:
    """record_id and the record as a gzip member; members joined in any order make a WARC file."""
    return derived.mapInArrow(_members, "record_id string, member binary")


def op4_warc(spark, sf_dir):
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in TEXT_STEPS:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')" if pattern[0] != "&" else f"replace({text}, {quote(pattern)}, {quote(to)})"
    uuid = lambda x: f"'<urn:uuid:' || substr({x},1,8) || '-' || substr({x},9,4) || '-' || substr({x},13,4) || '-' || substr({x},17,4) || '-' || substr({x},21,12) || '>'"
    return f"""WITH a AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
b AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest, {text} AS txt FROM a),
c AS (SELECT *, md5(concat_ws(chr(31), 'response', coalesce(CAST(page_id AS VARCHAR), ''), target_uri, source_digest)) AS h FROM b),
d AS (SELECT *, {uuid('h')} AS refers_to FROM c),
e AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, 'fetched-length: ' || strlen(payload) || chr(13) || chr(10) || 'http-status: 200' || chr(13) || chr(10) || 'source-digest: ' || source_digest || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(txt) || chr(13) || chr(10) AS block FROM d
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM d),
f AS (SELECT *, md5(concat_ws(chr(31), warc_type, refers_to)) AS g FROM e)
SELECT page_id, warc_type, {uuid('g')} AS record_id, refers_to, target_uri, '{WARC_DATE}' AS warc_date, content_type,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) AS source_headers,
  source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block FROM f"""


OP4_SQL = _sql()
