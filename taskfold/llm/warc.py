"""WARC archives of captured pages, and the index over their captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from taskfold.llm.loser_tree import merge
from taskfold.llm.tables import stored, table, while_writing
from taskfold.session import scratch_path

FILE_BYTES = 8 << 20
RANGE_ROWS = 50_000
#: Fixed values of the format.
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIRST_SECOND = 1_704_067_200  # pages carry no time: a page is captured that many seconds, and its id, after 1970


def base32_sha1(text: Column) -> Column:
    """Base32 of the SHA-1 of a string, in upper case: five hexadecimal digits make four letters."""
    digits = F.sha1(text)
    five = [F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(BASE32), F.shiftright(v, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for v in five for j in range(4)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, lower case, without scheme, user, www, port or fragment."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    found = lambda n: F.regexp_extract(plain, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?@]*@)?([^/?:]*)(?::\d*)?(.*)$", n)
    host = F.regexp_replace(F.lower(found(1)), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(found(2) == "", "/").otherwise(found(2)))


def _lines(*parts: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")), F.lit("")) for n, v in parts])


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record per row of ``pages`` (page_id, url, html): page_id, key, date, n_bytes, record.

    Of the records with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is the
    response, the others revisit it. Repeated rows with that page_id are all responses, as are rows with null
    page_ids among which no id is known. Null html is an empty payload; a null url leaves its line out; line
    ends in a url are escaped.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    own = own.withColumn("digest", base32_sha1(F.col("html"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    again = own.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    again = again.filter("n > 1").select("digest", "holder")
    known = own.join(again, "digest", "left").withColumn(
        "revisit", F.coalesce((F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull(), F.lit(False))
    )
    date = F.date_format(F.timestamp_seconds(F.lit(_FIRST_SECOND) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"), F.col("html")
    )
    block = F.when(F.col("revisit"), "").otherwise(http)
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), c, F.lit(">"))
    only = lambda c: F.when(F.col("revisit"), c)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            ("WARC-Record-ID", name(number)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", only(F.lit(PROFILE))),
            ("WARC-Refers-To", only(name(F.col("holder").cast("string")))),
            ("X-Payload-Length", F.col("n_bytes").cast("string")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n"),
        block,
    )
    return known.select("page_id", url_key(F.col("url")).alias("key"), date.alias("date"), "n_bytes", record.alias("record"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the records of ``pages`` to compressed files, each a run of captures sorted by URL key and time.

    Spark's text writer puts the two line ends after a record that the format asks for, and commits whole
    files, so a task that is repeated leaves nothing behind. Files hold as many records as make about
    ``file_bytes`` on average. Pages are shuffled once, by digest.
    """
    html = F.col("html").cast("string")
    total = pages.agg(F.sum(F.octet_length(html)), F.count("*")).first()
    each = ((total[0] or 0) + 600 * total[1]) // max(1, total[1])
    own = records(pages, least_bytes).sortWithinPartitions("key", "date", "page_id").select("record")
    most = max(1, file_bytes // max(1, each))
    with while_writing(pages.sparkSession):
        own.write.option("lineSep", END.decode()).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def parsed(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an unpacked archive."""
    at = 0
    while at < len(content):
        head = content.index(END, at)
        first, *lines = content[at:head].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = head + len(END)
        end = start + int(headers["Content-Length"])
        if content[end : end + len(END)] != END:
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield at, end + len(END) - at, headers, content[start:end]
        at = end + len(END)


_CAPTURE = pa.schema(
    [("run", pa.string()), ("key", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_CAPTURE_SQL = "run string, key string, date string, page_id long, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for offset, length, h, block in parsed(gzip.decompress(content.as_py())):
                digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                if h["WARC-Type"] == "response":
                    payload = block[block.index(END) + len(END) :]
                    if (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)) != (digest, size):
                        raise ValueError(f"{path}: the payload at byte {offset} is not what its header says")
                rows.append((path, h.get("WARC-Target-URI"), h["WARC-Date"], _number(h["WARC-Record-ID"]), offset, length, size, digest,
                             h["WARC-Type"], _number(h.get("WARC-Refers-To"))))
            columns = zip(*rows) if rows else [[]] * len(_CAPTURE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CAPTURE)], schema=_CAPTURE)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``. Payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = files.select("path", "content").mapInArrow(_captures, _CAPTURE_SQL)
    return found.withColumn("key", url_key(F.col("key")))


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0


def _merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of one range in order: the part of each run that fell into it, merged."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[0], []).append(row)
    for run in runs.values():
        if any(_order(a) > _order(b) for a, b in zip(run, run[1:])):  # two parts of a file arrived the other way round
            run.sort(key=_order)
    rows = list(merge([runs[r] for r in sorted(runs)], _order))
    if rows:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _CAPTURE)]
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64())],
            [*_CAPTURE.names, "part", "place"],
        )


def capture_index(captures: DataFrame) -> DataFrame:
    """The captures with ``position``: their place, from 0, in the order of URL key, time and page_id over all archives.

    Ranges of that order, of about RANGE_ROWS captures, are merged on their own: each gets its part of every
    sorted run. Cut points are whole (key, time, page_id), so the history of one hot URL spreads over ranges too.
    """
    captures = stored(captures, "captures")
    ranges = max(1, -(-captures.count() // RANGE_ROWS))
    dealt = captures.repartitionByRange(ranges, "key", "date", "page_id")
    merged = stored(dealt.mapInArrow(_merged_ranges, _CAPTURE_SQL + ", part long, place long"), "index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(F.broadcast(starts), "part").withColumn("position", F.col("start") + F.col("place")).drop("part", "place", "start")


def op5_warc(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "llm-warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return capture_index(read_captures(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string([substr('{BASE32}',
    CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS INT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INT), 1) FOR i IN range(0, 32)], '') AS b,
  max(page_id) OVER (PARTITION BY h) AS holder FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, b AS payload_digest, CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to FROM d
"""
