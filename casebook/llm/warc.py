"""WARC archives with revisit records for repeated payloads.

``resolve`` shuffles headers only: page ids and digests are stored, the digests that repeat are found by an aggregation that
reduces before it shuffles, and these, with their smallest page, are joined back to the pages.  They are broadcast while they are few
(``FEW_DIGESTS``, a checked number), so that no payload moves; beyond that, Spark joins by digest and splits the rows of one that is in very many pages.
``write`` writes one archive per part file through Spark's own writer, so that any
store will do; ``read`` parses whole archives as binary files, and resolves every revisit through the record that it names.

An archive is a sequence of WARC/1.1 records.  With ``compression="gzip"`` each archive is
one gzip member, which has to be read from its start.  Archives hold about ``ARCHIVE_BYTES`` of payload at most: long payloads go
to archives of their own, of fewer records.

Cases: null html is an empty payload; a null url is written empty; line breaks in urls are
dropped.  Of records with equal payloads the smallest page_id is the response; rows that repeat
that page_id are responses too.  Null page_ids are revisits of any other page with their
payload, and responses if there is none.  Payloads below ``least`` bytes are always
responses.  Empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from base64 import b32encode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

_END = "\r\n\r\n"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string"
_PARSED = "record_id string, refers_id string, known boolean, " + RECORD.replace("refers_to long, ", "")
#: Rows of an archive, and bytes of its payloads: part files stay small enough to be read whole.
ARCHIVE_ROWS, ARCHIVE_BYTES = 1500, 128 << 20
#: Payloads beyond this many bytes go to archives of fewer records.
LONG = ARCHIVE_BYTES // ARCHIVE_ROWS
#: Repeated digests that are broadcast, some 60 bytes each.
FEW_DIGESTS = 500_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8: five hex digits are four base32 digits."""
    digits = F.sha1(F.encode(payload, "UTF-8"))
    parts = [F.lpad(F.conv(F.substring(digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as records: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    records = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    records = records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    counts = records.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first"))
    repeated = store.materialize(counts.where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first"), "repeated")
    few = repeated.count() <= FEW_DIGESTS
    joined = records.join(F.broadcast(repeated) if few else repeated, F.col("payload_digest") == F.col("_digest"), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("payload_bytes") >= least)
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


def _uuid(page: Column, digest: Column) -> Column:
    """A record id that depends on the record only, so that a task run again writes the same."""
    h = F.sha1(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "none", archive_rows: int = ARCHIVE_ROWS) -> None:
    """Write what ``resolve`` returned as archives with fresh headers.  A revisit has no payload of its own."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        maybe("X-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("payload_digest"))))).otherwise(F.lit("Content-Type: text/html\r\n")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    )
    record = F.concat(head, F.lit(_END), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    def written(part: DataFrame, each: int) -> None:
        part.select(record.alias("value")).write.mode("append").option("lineSep", _END).option("compression", compression).option("maxRecordsPerFile", each).text(path)

    # sizes are those of the pages, so that these conditions reach the scan
    written(records.where(F.col("payload_bytes") <= LONG), archive_rows)
    long = records.where(F.col("payload_bytes") > LONG)
    if longest := long.agg(F.max("payload_bytes")).first()[0]:
        written(long, min(archive_rows, max(1, ARCHIVE_BYTES // longest)))


def parse(content: bytes):
    """Records of an archive as (headers with lower-case names, payload)."""
    if content[:2] == b"\x1f\x8b":
        content = zlib.decompress(content, 31)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower().decode(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, content[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives under ``path``.

    Digests of responses are computed from the payload that was read; one that differs from its header is an error.  A revisit has
    the page and the size of the response whose record it refers to; one that finds none is an error.
    """

    def records(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                for head, payload in parse(content):
                    said, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response":
                        found = b32encode(hashlib.sha1(payload).digest()).decode()
                        if said != found:
                            raise ValueError(f"payload of {head['warc-record-id']} has digest {found}, not {said}")
                    page = head.get("x-page-id")
                    rows.append((head["warc-record-id"], head.get("warc-refers-to"), page is not None, int(page or 0), head["warc-target-uri"], kind, len(payload), said, payload.decode() if payloads and kind == "response" else None))
            yield pd.DataFrame(rows, columns=re.findall(r"(\w+) \w+(?:,|$)", _PARSED))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    found = files.select("content").mapInPandas(records, _PARSED)
    found = found if payloads else found.drop("payload")
    # archives are parsed once: what revisits need of responses is a stored table of headers
    found = store.materialize(found, "records")
    own = F.when(F.col("known"), F.col("page_id"))
    revisits = found.where("record_type = 'revisit'")
    named = found.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_size"), F.col("payload_digest").alias("_digest"))
    named = named.join(revisits.select(F.col("refers_id").alias("_id")).distinct(), "_id", "left_semi").dropDuplicates(["_id"])
    wrong = F.raise_error(F.concat(F.lit("revisit of an unknown record: "), F.coalesce("refers_id", F.lit("none"))))
    good = F.col("_digest") == F.col("payload_digest")
    columns = [c.split()[0] for c in RECORD.split(", ")]
    out = revisits.join(named, F.col("refers_id") == F.col("_id"), "left").withColumns({"refers_to": F.when(good, F.col("_page")).otherwise(wrong.cast("long")), "payload_bytes": F.col("_size")})
    plain = found.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    kept = [c for c in columns if payloads or c != "payload"]
    return out.withColumn("page_id", own).select(kept).union(plain.withColumn("page_id", own).select(kept))
