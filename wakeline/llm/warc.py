r"""Operator 3, WARC derivatives: metadata and plain-text conversion records linked to their responses.

A response (record id, target uri, date, HTTP head, body) gives two records that refer to it.  The conversion holds the body's
plain text: comments, scripts, styles and tags go, the title and navigation stay, and every entity of HTML is decoded.  The metadata
holds the response's whole head (``source-status``, and a ``source-header-NAME`` for each header line), its content type and length, the
digests of its payload and of the text, and the number of links.  Both name the source's payload digest.  Digests are sha256.

A task packs its records into pieces of FILE_BYTES or so, and Spark's text writer makes each a file: a WARC record is head, block and an empty
line pair, and that pair is the line end.  :func:`read_warc` reads files back by Content-Length, so a block may hold anything; it refuses a
record that is cut off or whose block differs from its digest.

A null url has an empty target uri, a null body is empty (its text too); a null page_id is ``null`` in the record's id; repeated responses give
repeated records with equal ids; other columns may have any name; an empty table gives no file.  Pages of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import html
import html.entities
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_folder, read_table

LINE_END = "\r\n\r\n"
#: A file closes with the record with which it has so many bytes.
FILE_BYTES = 64 << 20
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Steps from HTML to text (patterns valid for Java and RE2, and what stands instead), before and after entities are decoded.
TAGS = (
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|body|html|head|title|nav)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
SPACES = (("\u00a0", " "), (r"[ \t\r]+", " "), (r" ?\n[ \n]*", "\n"))


def _uuid(seed: F.Column) -> F.Column:
    m = F.md5(seed)
    cut = lambda i, n: F.substring(m, i, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12), F.lit(">"))


def _steps(x: F.Column, steps: tuple) -> F.Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def _unescape(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())


def plain_text(body: F.Column) -> F.Column:
    """The whole text of HTML; named and numeric entities are decoded once, as browsers do."""
    body = _steps(F.arrow_udf(_unescape, "string")(_steps(body, TAGS)), SPACES)
    return F.trim(F.regexp_replace(body, r"^\n|\n$", ""))


def _head_fields(head: F.Column) -> F.Column:
    """A field for each line of an HTTP head, in order; folded lines are joined, and a line without a colon is a source-line."""
    lines = F.filter(F.split(F.regexp_replace(head, r"[ \t]*\r?\n[ \t]+", " "), r"\r?\n|\r"), lambda x: F.trim(x) != "")
    field = lambda x: F.when(x.rlike("^[^ \t:]+[ \t]*:"), F.concat(F.lit("source-header-"), F.regexp_replace(x, r"^([^ \t:]+)[ \t]*:[ \t]*", "$1: ")))
    status = lambda x, i: (i == 0) & x.rlike("^HTTP/")
    fields = F.transform(lines, lambda x, i: F.when(status(x, i), F.concat(F.lit("source-status: "), x)).otherwise(F.coalesce(field(x), F.concat(F.lit("source-line: "), x))))
    return F.array_join(F.transform(fields, lambda x: F.concat(x, F.lit("\r\n"))), "")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as response records: (record_id, target_uri, date, http_head, body)."""
    url = F.coalesce("url", F.lit(""))
    return pages.select(_uuid(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit("|"), url)).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"), F.lit(_HEAD).alias("http_head"), F.coalesce("html", F.lit("")).alias("body"))


def derivatives(source: DataFrame) -> DataFrame:
    """Response records to (record_id, record_type, refers_to, target_uri, head, block): two records each."""
    digest = F.concat(F.lit("sha256:"), F.sha2("body", 256))
    s = source.withColumn("http_head", F.coalesce("http_head", F.lit(""))).withColumn("payload_digest", digest).withColumn("text", plain_text(F.col("body")))
    s = s.withColumn("source_type", F.regexp_extract("http_head", r"(?im)^content-type[ \t]*:[ \t]*([^\r\n]*)", 1))
    links = F.regexp_count("body", F.lit(r"(?i)<a\b[^>]*\bhref="))
    fields = F.concat(
        _head_fields(F.col("http_head")), F.lit("source-content-type: "), "source_type", F.lit("\r\nsource-content-length: "), F.octet_length("body").cast("string"), F.lit("\r\nsource-payload-digest: "), "payload_digest",
        F.lit("\r\ntext-digest: sha256:"), F.sha2("text", 256), F.lit("\r\noutlinks: "), links.cast("string"), F.lit("\r\n"),
    )
    kind = lambda name, mime, block: F.struct(F.lit(name).alias("record_type"), F.lit(mime).alias("mime"), block.alias("block"))
    s = s.select("record_id", "target_uri", "date", "payload_digest", F.explode(F.array(kind("metadata", "application/warc-fields", fields), kind("conversion", "text/plain; charset=utf-8", F.col("text")))).alias("r"))
    s = s.select(_uuid(F.concat("record_id", F.lit("|"), "r.record_type")).alias("own_id"), "r.*", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), "record_type", F.lit("\r\nWARC-Record-ID: "), "own_id", F.lit("\r\nWARC-Refers-To: "), "refers_to", F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("target_uri", r"[\r\n]", " "),
        F.lit("\r\nWARC-Date: "), "date", F.lit("\r\nWARC-Source-Payload-Digest: "), "payload_digest", F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2("block", 256), F.lit("\r\nContent-Type: "), "mime",
        F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    return s.select(F.col("own_id").alias("record_id"), "record_type", "refers_to", "target_uri", head.alias("head"), "block")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record) to (piece): records end to end, some FILE_BYTES each."""
    end, held, n = LINE_END.encode(), [], 0
    for batch in batches:
        for record in batch.column(0):
            raw = record.as_buffer()
            held.append(raw)
            n += len(raw)
            if n >= FILE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], names=["piece"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([end.join(held)], pa.binary())], names=["piece"])


def write_warc(records: DataFrame, folder: str) -> None:
    pieces = records.select(F.concat("head", "block")).mapInArrow(_pack, "piece binary")
    pieces.select(F.col("piece").cast("string")).write.option("lineSep", LINE_END).option("maxRecordsPerFile", 1).text(folder)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's head is cut off")
        fields = dict(line.split(": ", 1) for line in raw[at:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        if end + 4 + size > len(raw):
            raise ValueError(f"record {fields['WARC-Record-ID']} is cut off")
        yield fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + len(LINE_END)


_KINDS = (("record_id", "WARC-Record-ID"), ("record_type", "WARC-Type"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"), ("source_digest", "WARC-Source-Payload-Digest"), ("content_type", "Content-Type"), ("block_digest", "WARC-Block-Digest"))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in parse_warc(content.as_buffer().to_pybytes()):
                if fields["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                rows.append((*(fields[k] for _, k in _KINDS), len(block), block))
            for i in range(0, len(rows), 1000):
                cols = list(zip(*rows[i : i + 1000], strict=True))
                kinds = [*[pa.string()] * len(_KINDS), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*(k for k, _ in _KINDS), "block_bytes", "block"])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of a folder, its block checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(_parse, ", ".join(f"{k} string" for k, _ in _KINDS) + ", block_bytes long, block binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    write_warc(derivatives(responses(read_table(spark, sf_dir, "pages"))), folder)
    return read_warc(spark, folder).drop("block")


def _entities_sql() -> str:
    """Tables of the named entities (from Python's own table of HTML 5): all, and those that end without a semicolon."""
    chars = lambda text: " || ".join(f"chr({ord(c)})" for c in text)
    rows = lambda names: ", ".join(f"('{name}', {chars(html.entities.html5[name])})" for name in names)
    return f"entity(name, txt) AS (SELECT * FROM (VALUES {rows(html.entities.html5)})), short(name, txt) AS (SELECT * FROM entity WHERE NOT ends_with(name, ';'))"


def _number_sql(n: str) -> str:
    """The character of a numeric entity: Windows-1252 where HTML says so, none for other control characters, a replacement mark for what is no character."""
    odd = " ".join(f"WHEN {k} THEN chr({ord(v)})" for k, v in html._invalid_charrefs.items() if k)
    none = ", ".join(str(k) for k in sorted(html._invalid_codepoints))
    return f"(CASE {n} {odd} WHEN 0 THEN chr(65533) ELSE CASE WHEN {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN chr(65533) WHEN {n} IN ({none}) THEN '' ELSE chr({n}) END END)"


def _steps_sql(x: str, steps: tuple) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_UUID_SQL = "'<urn:uuid:' || substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12) || '>'"
OP3_SQL = rf"""
WITH {_entities_sql()},
r AS (SELECT row_number() OVER () AS k, {_UUID_SQL.format("coalesce(CAST(page_id AS VARCHAR), 'null') || '|' || coalesce(url, '')")} AS refers_to, coalesce(url, '') AS target_uri, coalesce(html, '') AS body FROM pages),
p0 AS (SELECT k, unnest(string_split(x, '&')) AS p, generate_subscripts(string_split(x, '&'), 1) AS i FROM (SELECT k, {_steps_sql('body', TAGS)} AS x FROM r)),
p AS (SELECT k, i, p, CASE WHEN i = 1 THEN '' ELSE regexp_extract(p, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{{1,32}};?)') END AS ref FROM p0),
q AS (SELECT p.*, e.txt AS named, CASE WHEN ref LIKE '#%' THEN CAST(CASE WHEN lower(ref[2]) = 'x' THEN '0x' || rtrim(ref[3:], ';') ELSE rtrim(ref[2:], ';') END AS HUGEINT) END AS num,
  CASE WHEN e.txt IS NULL AND ref <> '' AND ref NOT LIKE '#%' THEN (SELECT arg_max(s.name, length(s.name)) FROM short s WHERE starts_with(ref, s.name)) END AS head FROM p LEFT JOIN entity e ON e.name = p.ref),
d AS (SELECT k, string_agg(CASE WHEN i = 1 THEN p WHEN ref = '' THEN '&' || p WHEN num IS NOT NULL THEN {_number_sql('num::INTEGER')} || p[length(ref) + 1:] WHEN named IS NOT NULL THEN named || p[length(ref) + 1:]
  WHEN head IS NOT NULL THEN (SELECT s.txt FROM short s WHERE s.name = head) || p[length(head) + 1:] ELSE '&' || p END, '' ORDER BY i) AS x FROM q GROUP BY k),
t AS (SELECT r.*, 'sha256:' || sha256(body) AS source_digest, trim(regexp_replace({_steps_sql('d.x', SPACES)}, '^\n|\n$', '', 'g'), ' ') AS txt FROM r JOIN d USING (k)),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type, 'source-status: HTTP/1.1 200 OK' || chr(13) || chr(10) || 'source-header-Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'source-content-type: text/html; charset=utf-8' || chr(13) || chr(10) || 'source-content-length: ' || strlen(body) || chr(13) || chr(10)
    || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) || 'text-digest: sha256:' || sha256(txt) || chr(13) || chr(10) || 'outlinks: ' || len(regexp_extract_all(body, '(?i)<a\b[^>]*\bhref=')) || chr(13) || chr(10) AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', txt FROM t)
SELECT {_UUID_SQL.format("refers_to || '|' || record_type")} AS record_id, record_type, refers_to, target_uri, source_digest, content_type, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS block_bytes FROM b
"""
