"""WARC archives: write pages, read them back by boundary-chain verification.

A reader can't trust the magic at the start of a record: payloads may hold it too. So each task lists every place of its
archives that reads like a record head, with the offset at which the next record must start if this one is real. These
candidate links form chains; pointer jumping over all archives at once keeps the candidates that the start of their file
reaches, in a number of rounds that grows with the logarithm of the longest chain. Magic inside a payload starts chains of
its own, which no file start reaches.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

_END = "\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Archives are written without a clock, so that equal pages give equal archives.
_DATE = "2000-01-01T00:00:00Z"


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 100, records_per_archive: int = 1000) -> None:
    """One WARC/1.1 record per row of `pages` (`page_id`, `url`, `html`) in archives under `path`.

    The payload is the html in UTF-8 (null: empty), behind an HTTP head that states its length. Of the rows with equal
    payloads of at least `revisit_bytes` bytes, that with the smallest `page_id` is a response and the others are revisits
    that refer to it and carry no payload; rows that repeat the smallest id are responses too, and so are rows without an id
    where no equal payload has one. Line ends in a URL are left out, a null URL gives no target.

    An archive ends with its task's rows or after `records_per_archive` records, so that one archive fits a reading task.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("url"), html.alias("body"))
    rows = rows.withColumns({"digest": F.sha2(F.col("body").cast("binary"), 256), "size": F.octet_length("body")})
    # Only payloads that repeat take part in the join, so pages without copies need no shuffle of their texts.
    firsts = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = cut_lineage(firsts.where("n > 1").select(F.col("digest").alias("_digest"), "first"))
    rows = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace("url", r"[\r\n]+", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(_END))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {_DATE}"), F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", records_per_archive).text(path)


def record_candidates(data: bytes) -> Iterator[tuple[int, int, dict[str, str], int]]:
    """Every place that reads like a record and fits the archive: offset, successor's offset, head fields, block's start.

    A record starts the file or follows the blank line that ends another, and a head ends with the first blank line; so no
    two heads overlap, and heads of any length are read in linear time.
    """
    for m in _MAGIC.finditer(data):
        if m.start() and data[max(0, m.start() - 4):m.start()] != b"\r\n\r\n":
            continue
        stop = data.find(b"\r\n\r\n", m.end() - 2)
        if stop < 0:
            continue
        fields = {}
        for line in data[m.end():stop].split(b"\r\n"):
            key, colon, value = line.partition(b":")
            if colon:
                fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        length = fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,15}", length):
            continue
        end = stop + 4 + int(length)
        if data[end:end + 4] == b"\r\n\r\n":
            yield m.start(), end + 4, fields, stop + 4


def _page(name: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", name or "")
    return int(m[1]) if m else None


def _parsed(payloads: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["archive"], batch["content"]):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                out = []
                for offset, after, fields, start in record_candidates(data):
                    block = data[start:after - 4]
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, stated = fields.get("warc-type"), re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,15})", http)
                    size = int(stated[1]) if stated else len(body)
                    digest = hashlib.sha256(body).hexdigest() if kind != "revisit" else fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    out.append((archive, offset, after if after < len(data) else None, kind, _page(fields.get("warc-record-id")), _page(fields.get("warc-refers-to")),
                                fields.get("warc-target-uri"), size if kind == "revisit" else len(body), digest, body if payloads else None))
                frame = pd.DataFrame(out, columns=["archive", "offset", "after", "record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", "payload"])
                yield frame.astype({"after": "Int64", "page_id": "Int64", "refers_to": "Int64"})

    return parse


def reachable(links: DataFrame) -> DataFrame:
    """`f`, `offset` of the rows of `links` (`f`, `offset`, `after`) that offset 0 of their file `f` reaches.

    After round k a row's jump leads 2^k records on, and the rows within 2^k records of the start are marked.
    """
    state = cut_lineage(links.select("f", "offset", F.col("after").alias("jump"), (F.col("offset") == 0).alias("r")))
    while state.where("jump is not null and r").limit(1).count():
        onward = state.select(F.col("f").alias("f2"), F.col("offset").alias("o2"), F.col("jump").alias("jump2"))
        marks = state.where("r and jump is not null").select(F.col("f").alias("f3"), F.col("jump").alias("o3")).distinct()
        moved = state.join(onward, (F.col("f") == F.col("f2")) & (F.col("jump") == F.col("o2")), "left")
        marked = moved.join(marks, (F.col("f") == F.col("f3")) & (F.col("offset") == F.col("o3")), "left")
        state = cut_lineage(marked.select("f", "offset", F.col("jump2").alias("jump"), (F.col("r") | F.col("o3").isNotNull()).alias("r")))
    return state.where("r").select("f", "offset")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The real records of all archives under `path`, plain or gzip: `archive`, `offset`, `record_type`, `page_id`,
    `refers_to`, `url`, `payload_bytes`, `payload_digest` and, on request, `payload`.

    Size and digest are taken from the payload itself; for revisits, which have none, from the record's heads. A record cut
    off by the end of its file, and all that follows a broken record, is left out. No archive gives no row.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("archive"), "content")
    schema = "archive string, offset long, after long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    found = cut_lineage(files.mapInPandas(_parsed(payloads), schema).withColumn("f", F.xxhash64("archive")))
    kept = reachable(found.select("f", "offset", "after"))
    rows = found.join(kept.withColumnsRenamed({"f": "f1", "offset": "offset1"}), (F.col("f") == F.col("f1")) & (F.col("offset") == F.col("offset1")))
    out = ["archive", "offset", "record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest"]
    return rows.select(*out, *(["payload"] if payloads else []))
