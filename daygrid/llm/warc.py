"""WARC archives: writing, reading, and revisit resolution.

Records are gathered into archives by their bytes and written by Spark's text writer, one
value per archive, so that archives come from committed tasks and land wherever Spark can
write. They are read as whole files and cut by their Content-Length. Revisits are resolved
on headers alone: these name the archive and the place of their record, so that verdicts
travel to the archives and no payload is shuffled by its digest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.session import bounded, durable, fresh_path

#: Bytes that an archive of several records may hold, and records that leave a task together.
ARCHIVE_BYTES, RECORDS = 32_000_000, 500
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL, END = "\r\n", b"\r\n\r\n"
SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside the value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(EOL)), F.lit(""))


def _record() -> Column:
    """One WARC record of a row of SCHEMA (without payload for revisits), with fresh headers."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"),
                    _line("Content-Length", F.col("payload_bytes")), F.lit(EOL))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string"))
    name = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", name(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), _line("WARC-Refers-To", F.when(revisit, name(F.col("refers_to")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(http) + F.octet_length(body)), F.lit(EOL))
    return F.concat(head, http, body)


def write_archives(records: DataFrame, path: str) -> None:
    """Write rows of SCHEMA as gzip archives of at most ARCHIVE_BYTES, or of one record."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for cell in batch.column(0):
                record = cell.as_py()
                if held and size + len(record) > ARCHIVE_BYTES:
                    yield whole()
                    held, size = [], 0
                held.append(record)
                size += len(record) + len(END)
        if held:
            yield whole()

    archives = records.select(_record().cast("binary").alias("value")).mapInArrow(gather, "value binary")
    (archives.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", 1).text(path))


class _Reader:
    """Bytes of a gzip archive on demand: no more of it is unpacked than a record needs."""

    def __init__(self, data: bytes, size: int = 1 << 20) -> None:
        self.data, self.at, self.size = data, 0, size
        self.gzip = zlib.decompressobj(wbits=47) if data[:2] == b"\x1f\x8b" else None
        self.held = bytearray()

    def _more(self) -> bool:
        if self.gzip is not None and self.gzip.eof and self.gzip.unused_data:  # the next member
            self.at -= len(self.gzip.unused_data)
            self.gzip = zlib.decompressobj(wbits=47)
        part = self.data[self.at : self.at + self.size]
        self.at += len(part)
        self.held += self.gzip.decompress(part) if self.gzip else part
        return bool(part)

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, as rows of SCHEMA."""
    reader = _Reader(data)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split(EOL)[1:] if ": " in x)
        block = reader.take(int(fields["Content-Length"]))
        reader.take(4)
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next((int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")), None)
        page = lambda v: int(v[len("<urn:page:") : -1]) if v else None
        revisit = fields["WARC-Type"] == "revisit"
        yield {"page_id": page(fields.get("WARC-Record-ID")), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
               "refers_to": page(fields.get("WARC-Refers-To")), "payload_digest": fields.get("WARC-Payload-Digest", "sha1:")[5:],
               "payload_bytes": length if revisit else len(payload), "payload": None if revisit else payload}


def _read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Rows of SCHEMA with the archive and the place of their record in it.

    ``files`` are (path, content), and may have ``moved``: the (place, refers_to) of records
    that become revisits.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()),
             ("place", pa.int64())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])

        for batch in batches:
            for n in range(batch.num_rows):
                archive, content = (batch.column(k)[n].as_py() for k in (0, 1))
                moved = {m["place"]: m["refers_to"] for m in batch.column(2)[n].as_py() or ()} if batch.num_columns > 2 else {}
                held, size = [], 0
                for place, record in enumerate(parse(content)):
                    record |= {"archive": archive, "place": place}
                    if record["payload"] is not None:
                        record["payload_digest"] = hashlib.sha1(record["payload"]).hexdigest()
                        if not with_payload:
                            record["payload"] = None
                    if place in moved:
                        record |= {"record_type": "revisit", "refers_to": moved[place], "payload": None}
                    held.append(record)
                    size += len(record["payload"] or b"")
                    if len(held) >= RECORDS or size > 8_000_000:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    return files.mapInArrow(read, f"{SCHEMA}, archive string, place long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Rows of SCHEMA; without payload, responses carry the digest and size of what was read."""
    return _read(_files(spark, path), with_payload).drop("archive", "place")


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``records`` with record_type and refers_to set anew.

    Headers meet by payload digest: of the responses with equal payloads of at least
    ``min_bytes``, the one with the largest page_id is the original and the others revisit
    it; revisit records of the input are joined to that original, and keep their reference
    if there is none. Responses without page_id stay responses, unless an original exists.
    """
    responses = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= min_bytes))
    originals = (responses.groupBy("payload_digest").agg(F.max("page_id").alias("_original"), F.count("*").alias("_n"))
                 .where(F.col("_original").isNotNull()).select(F.col("payload_digest").alias("_digest"), "_original"))
    large = (F.col("record_type") == "revisit") | (F.col("payload_bytes") >= min_bytes)
    joined = records.join(originals, large & (F.col("payload_digest") == F.col("_digest")), "left")
    moved = F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original"))
    new = {"refers_to": F.when(moved, F.col("_original")).otherwise(F.when(F.col("record_type") == "revisit", F.col("refers_to"))),
           "record_type": F.when(moved, F.lit("revisit")).otherwise(F.col("record_type"))}
    if "payload" in records.columns:
        new["payload"] = F.when(~moved, F.col("payload"))
    return joined.withColumns(new).select(*records.columns)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Write every page as a response record; returns the folder of the archives."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = (pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
            .withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "payload_digest": F.sha1("payload"),
                          "payload_bytes": F.octet_length("payload")}))
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(rows, path)
    return path


def deduplicated_archives(spark: SparkSession, source: str, min_bytes: int = 1000) -> str:
    """Read archives, resolve revisits, write archives without repeated payloads.

    The headers are stored once with the places of their records, and only they meet by
    digest. Each archive is then read against its own verdicts, at most one for each of its
    records: by broadcast where all of them are proven small, else the archives move, packed
    as they are, to their verdicts.
    """
    heads = durable(_read(_files(spark, source), with_payload=False).select(
        "page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "archive", "place"), "warc-heads")
    revisits = resolve_revisits(heads, min_bytes).where("record_type = 'revisit'")
    verdicts = bounded(revisits.groupBy("archive").agg(F.collect_list(F.struct("place", "refers_to")).alias("moved")))
    files = _files(spark, source).join(verdicts, F.col("path") == F.col("archive"), "left").select("path", "content", "moved")
    path = fresh_path(spark, "warc")
    write_archives(_read(files), path)
    return path


def archived(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, a
    revisit with the digest and size of the response it refers to.

    Null html is an empty payload. Rows that repeat a page_id are records of their own;
    null page_ids stay null.
    """
    found = durable(read_archives(spark, path, with_payload=False).drop("payload", "url"), "warc-heads")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = (found.where("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
                 .agg(F.max("payload_bytes").alias("_bytes")))
    revisits = found.where("record_type = 'revisit'").join(
        responses, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("_bytes", "payload_bytes"))
    return found.where("record_type = 'response'").select(*columns).unionByName(revisits.select(*columns))
