"""WARC archives: records written as text parts, read by any number of tasks, segments put together again.

`written` turns pages into HTTP responses with chunked framing. Of pages with equal payloads, that with the greatest page_id (then the last row) is a response and the others
revisit it, without a body. A record whose block is longer than `segment` bytes is cut: the first part is the response, others are continuation records with the first
one's id as origin, a segment number, and the total length in the last. Spark's text sink writes them, as a record's end is a line's end to it; a file is one gzip stream of many records.

`records` reads archives (also of other writers, plain or gzip) by Spark's text source, cut at the version mark that begins a record. A plain file may be read by many tasks. Where a
block holds that mark itself, it is shorter than it says, and the parts are joined again; a block that also spans two tasks' parts of a file has that file read in order by one task, a record at a time.
`reassembled` deals continuation records by origin, sorts them by segment number and runs through them: the chunked framing is undone piece by piece, bytes counted and
digested as they come, so a record is never held whole unless its payload is asked for. Lengths and digests that don't hold, and segments that are missing, are told in `problem`.

A null html is an empty payload. A null url is an empty target. Null page_ids are least, pages without one are told apart by their rows; repeated rows each are a record. Texts may hold anything,
also what looks like a record. Repeated segments count once. An empty table gives an empty archive. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import HOT, dropped, met, new_path, staged, table

#: What begins a record, of which no part but the whole begins again: a search for it can't miss one.
MARK = b"WARC/1."
#: Bytes of a segment's block, of a chunk of HTTP, and records of a file.
SEGMENT, CHUNK, PER_FILE = 8192, 4096, 100_000
#: Fixed values of the format; a page tells no date, so all records have the same.
DATE, PROFILE = "2000-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes within which a record's head ends.
HEAD = 1 << 20
_PARSED = (
    "file string, cut boolean, record_id string, kind string, page_id long, target string, refers_to string, digest string, origin string, segment int, total long, "
    "n_bytes long, made_digest string, block binary, problem string"
)
_FIELDS = [("file", pa.string()), ("cut", pa.bool_()), ("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("target", pa.string()), ("refers_to", pa.string()), ("digest", pa.string())]
_FIELDS += [("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("n_bytes", pa.int64()), ("made_digest", pa.string()), ("block", pa.binary()), ("problem", pa.string())]
_ARROW = pa.schema(_FIELDS)
#: Bytes of blocks that one batch of parsed records holds.
_BATCH_BYTES = 8_000_000


def digested(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# writing


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    """data in HTTP's chunked framing."""
    parts = [b"%x\r\n%b\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block


def _id(archive: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), name)}>"


def _pieces(archive: str, page_id: int | None, url: str, payload: str, html: bytes | None, digest: str, row: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """A page's record, or its segments; without html, the row's revisit of the page that has it."""
    name = payload if html is not None else f"row {row}"
    own = [("WARC-Record-ID", _id(archive, name)), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    own += [("Page-Id", str(page_id))] if page_id is not None else []
    kind, head = ("Content-Type", "application/http;msgtype=response"), b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if html is None:
        yield _record([("WARC-Type", "revisit"), *own, ("WARC-Refers-To", _id(archive, payload)), ("WARC-Profile", PROFILE), kind], head)
        return
    block = head + chunked(html, chunk)
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        more = [("WARC-Segment-Number", str(number))] if len(cuts) > 1 else []
        if number == 1:
            yield _record([("WARC-Type", "response"), *own, *more, kind], block[:segment])
        else:
            more += [("WARC-Segment-Total-Length", str(len(block)))] if number == len(cuts) else []
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", _id(archive, f"{name} {number}")), ("WARC-Date", DATE), ("WARC-Target-URI", _target(url)), ("WARC-Segment-Origin-ID", _id(archive, name)), *more], block[at : at + segment])


def _target(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def written(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, per_file: int = PER_FILE) -> None:
    """pages (page_id, url, html) as an archive below path.

    Payloads are dealt by their SHA-256 to count them, without the pages. Pages whose payload is theirs alone are written from where they are read, or, where there are too many
    copied payloads to send to all tasks, are shuffled once. Of copied payloads one html each is shuffled; revisits carry none.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload"))
    counts, counts_path = staged(rows.groupBy("payload").agg(F.count("*").alias("n")).filter("n > 1"), "payloads")
    copied = counts.select("payload")
    hot = F.broadcast(counts.filter(F.col("n") * HOT > pages.count()).select("payload"))  # less than HOT rows
    alone = rows.join(hot, "payload", "left_anti").join(copied, "payload", "left_anti")
    several, several_path = staged(met(rows.select("page_id", "url", "payload", F.sha1("html").alias("sha1")), copied, "payload").withColumn("row", F.monotonically_increasing_id()), "copies")
    last = several.groupBy("payload").agg(F.max(F.struct("page_id", "row", "url")).alias("last"))
    bodies = rows.join(hot, "payload", "left_semi").unionByName(rows.join(hot, "payload", "left_anti").join(copied, "payload", "left_semi")).groupBy("payload").agg(F.first("html").alias("html"))
    shown = last.join(bodies, "payload").select("payload", "last.page_id", "last.url", "html")
    revisits = met(several, last.select("payload", F.col("last.row").alias("first")), "payload").filter("row <> first")
    nothing = {"row": F.lit(None).cast("long"), "sha1": F.lit(None).cast("string"), "html": F.lit(None).cast("binary")}
    out = [x.withColumns({k: v for k, v in nothing.items() if k not in x.columns}).select("page_id", "url", "payload", "html", "sha1", "row") for x in (alone, shown, revisits)]
    archive = str(uuid.uuid4())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes] = []
            held = 0
            for row in zip(*batch.columns, strict=True):
                page_id, url, payload, body, sha1, number = (x.as_py() for x in row)
                digest = digested(body) if body is not None else base64.b32encode(bytes.fromhex(sha1)).decode()
                for record in _pieces(archive, page_id, url, payload, body, digest, number, segment, chunk):
                    made.append(record)
                    held += len(record)
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                        made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    text = out[0].unionByName(out[1]).unionByName(out[2]).mapInArrow(run, "record binary")
    # the sink ends each line by what ends a record, and writes the bytes as they are
    text.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    dropped(spark, counts_path)
    dropped(spark, several_path)


# reading


class Body:
    """The payload of an HTTP message fed in pieces: what stands after its head, with chunked framing undone."""

    def __init__(self, keep: bool) -> None:
        self.keep, self.sha1, self.n, self.parts = keep, hashlib.sha1(), 0, []
        self.rest, self.state, self.left, self.plain = b"", "head", 0, False

    def _take(self, data: bytes) -> None:
        self.sha1.update(data)
        self.n += len(data)
        if self.keep:
            self.parts.append(data)

    def feed(self, data: bytes) -> None:
        data, at = self.rest + data if self.rest else data, 0
        self.rest = b""
        while at < len(data):
            if self.state == "head":
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self.plain = not re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", data[at:end])
                self.state, at = ("plain" if self.plain else "size"), end + 4
            elif self.state == "plain":
                self._take(data[at:])
                at = len(data)
            elif self.state == "size":
                end = data.find(b"\r\n", at)
                if end < 0:
                    break
                size = re.match(rb"\s*([0-9A-Fa-f]+)", data[at:end])
                self.state, self.left = ("data", int(size[1], 16)) if size else ("broken", 0)
                at = end + 2
                if size and not self.left:
                    self.state = "over"
            elif self.state == "data":
                part = data[at : at + self.left]
                self._take(part)
                at += len(part)
                self.left -= len(part)
                if not self.left:
                    self.state = "line"
            elif self.state == "line":
                if len(data) - at < 2:
                    break
                self.state, at = ("size" if data[at : at + 2] == b"\r\n" else "broken"), at + 2
            else:  # trailers, or what can't be read
                return
        self.rest = data[at:]

    @property
    def problem(self) -> str | None:
        return None if self.state in ("plain", "over") else "the framing is broken" if self.state == "broken" else "the framing has no end"

    def digest(self) -> str:
        return base64.b32encode(self.sha1.digest()).decode()

    def payload(self) -> bytes | None:
        return b"".join(self.parts) if self.keep else None


def _headed(data: bytearray) -> tuple[dict[str, str], int, int] | None:
    """Fields, where the block begins and how long it is, of what follows a mark; None if that is no record."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in data[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]))
    size = fields.get("content-length", "")
    return (fields, end + 4, int(size)) if size.isdecimal() and "warc-type" in fields else None


def _whole(number: str | None) -> int | None:
    return int(number) if number and re.fullmatch(r"-?\d{1,18}", number) else None


def _row(file: str, fields: dict[str, str], block: bytes, keep: bool) -> dict:
    kind, number = fields["warc-type"].lower(), _whole(fields.get("warc-segment-number"))
    text = lambda name: fields[name].encode("utf-8", "surrogateescape").decode("utf-8", "replace") if name in fields else None
    row = {"file": file, "cut": False, "record_id": text("warc-record-id"), "kind": kind, "page_id": _whole(fields.get("page-id")), "target": text("warc-target-uri"), "refers_to": text("warc-refers-to")}
    row |= {"digest": (text("warc-payload-digest") or "").removeprefix("sha1:") or None, "origin": text("warc-segment-origin-id"), "segment": number, "total": _whole(fields.get("warc-segment-total-length"))}
    if kind == "continuation" or number is not None:  # a part of a record waits for the others
        return row | {"origin": row["origin"] or row["record_id"], "segment": number, "block": block}
    if kind in ("response", "resource"):
        body = Body(keep)
        if kind == "resource":
            body.state = "plain"
        body.feed(block)
        row |= {"n_bytes": body.n, "made_digest": body.digest(), "block": body.payload(), "problem": body.problem or _mismatch(row["digest"], body.digest())}
    return row


def _mismatch(said: str | None, made: str) -> str | None:
    return "the payload has another digest" if said and said != made else None


def _parsed(keep: bool, whole_files: bool):
    """A function of batches of (file, at, value) to rows of _PARSED: the text between two marks begins a record, or goes on with one whose block holds a mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held, place, data, need = 0, None, bytearray(), None  # of the record that isn't yet as long as it says

        def ended() -> list[dict]:
            """What is left open where a task's part of a file ends."""
            if not data:
                return []
            return [{"file": place[0], "cut": False, "problem": "the file ends within a record"} if whole_files else {"file": place[0], "cut": True}]

        for batch in batches:
            for file, at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                here = (file,) if whole_files else (file, at)
                if here != place:
                    rows += ended()
                    place, data, need = here, bytearray(), None
                more = value.as_py()
                if data:
                    data += MARK + more
                elif more.strip(b"\r\n"):
                    data += more
                need = _need(data) if need is None and data else need
                if need is None or len(data) < need:
                    continue
                if need < 0:
                    rows.append({"file": file, "cut": False, "problem": "not a record"})
                else:
                    fields, begin, n = _headed(data)
                    rows.append(_row(file, fields, bytes(data[begin : begin + n]), keep))
                    held += n
                data, need = bytearray(), None
                if held > _BATCH_BYTES or len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        rows += ended()
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def _need(data: bytearray) -> int | None:
    """Bytes that a record has; None if its head goes on, -1 if it is none."""
    if (head := _headed(data)) is not None:
        return head[1] + head[2]
    return None if b"\r\n\r\n" not in data and len(data) < HEAD else -1


def records(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """A row for each record below path, with the fields of its head; of responses that aren't segmented also n_bytes and made_digest of the payload, which `keep` puts
    into `block`; of segments the block. `problem` says what doesn't hold. Written to the shared folder."""
    parts = spark.read.option("lineSep", MARK.decode()).option("recursiveFileLookup", True).text(path)
    parts = parts.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))
    first, _ = staged(parts.mapInArrow(_parsed(keep, False), _PARSED), "records")
    cut = first.filter("cut").select("file").distinct()
    if cut.isEmpty():
        return first
    # a block with a mark of its own at the border of two tasks: such files are read again, in order, without one
    again = parts.join(cut, "file", "left_semi").withColumn("row", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "at", "row").select("file", "at", "value")
    rest, _ = staged(again.mapInArrow(_parsed(keep, True), _PARSED), "records-again")
    return first.join(cut, "file", "left_anti").unionByName(rest)


def _rejoined(keep: bool):
    """A function of batches of segments, sorted by origin and number, to a row for each origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        origin = head = body = total = None
        last, length, held = 0, 0, 0

        def ended() -> list[dict]:
            if origin is None:
                return []
            gap = "segments are missing" if head is None or total is None or last < 2 else None
            short = "the segments have another length than is said" if total is not None and total != length else None
            own = head or {"file": None, "cut": False, "kind": "response"}
            made = {"record_id": origin, "n_bytes": body.n, "made_digest": body.digest(), "block": body.payload()}
            return [own | made | {"problem": gap or problem or short or body.problem or _mismatch(own.get("digest"), body.digest())}]

        problem = None
        for batch in batches:
            for part in (dict(zip(_ARROW.names, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if part["origin"] != origin:
                    rows += ended()
                    held += len(rows[-1]["block"] or b"") if rows else 0
                    origin, head, body, total, last, length, problem = part["origin"], None, Body(keep), None, 0, 0, None
                    if held > _BATCH_BYTES or len(rows) > 2000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                number = part["segment"] or 0
                if number == last:  # a repeated segment
                    continue
                if number != last + 1:
                    problem = problem or "segments are missing"
                if number == 1:
                    head = {k: part[k] for k in ("file", "cut", "kind", "page_id", "target", "refers_to", "digest")}
                    if part["kind"] == "resource":
                        body.state = "plain"
                total, last, length = part["total"] if part["total"] is not None else total, number, length + len(part["block"])
                body.feed(part["block"])
        rows += ended()
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def reassembled(found: DataFrame, keep: bool = False) -> DataFrame:
    """Of `records`, a row for each record: segments of one origin joined in order, with n_bytes, made_digest and, if `keep`, the payload in `block`."""
    is_part = F.col("segment").isNotNull() & F.col("origin").isNotNull()
    stray = (F.col("kind") == "continuation") & ~is_part
    parts = found.filter(is_part).repartition("origin").sortWithinPartitions("origin", "segment", "record_id")
    joined = parts.mapInArrow(_rejoined(keep), _PARSED)
    rest = found.filter(~is_part).withColumn("problem", F.when(stray, "a segment without an origin or number").otherwise(F.col("problem")))
    return rest.unionByName(joined).drop("origin", "segment", "total", "cut")


def resolved(whole: DataFrame) -> DataFrame:
    """page_id, n_bytes, digest, kind, refers_to (a page_id) of responses and of revisits, which have the length and digest of what they refer to; both as read, not as said."""
    shown = whole.filter("kind = 'response' AND problem IS NULL").select("record_id", "page_id", "n_bytes", "made_digest")
    revisits = whole.filter("kind = 'revisit'").select("page_id", "digest", F.col("refers_to").alias("record_id"))
    wanted = revisits.select("record_id").distinct()
    of = shown.join(wanted, "record_id", "left_semi").select("record_id", "n_bytes", "made_digest", F.col("page_id").alias("first"))
    again = met(revisits, of, "record_id").filter("digest = made_digest")
    out = shown.select("page_id", "n_bytes", F.col("made_digest").alias("digest"), F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    return out.unionByName(again.select("page_id", "n_bytes", "digest", F.lit("revisit").alias("kind"), F.col("first").alias("refers_to")))


def op11_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through an archive and back."""
    path = new_path(spark, "warc")
    written(table(spark, sf_dir, "pages"), path)
    whole, _ = staged(reassembled(records(spark, path)), "reassembled")
    bad: Column = F.col("problem").isNotNull()
    if (n := whole.filter(bad).count()):
        raise ValueError(f"{n} records were not read as they were written")
    out = resolved(whole)
    return out.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


#: base32 from hexadecimal: five digits are four letters.
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> b) & 31) + 1)::BIGINT, 1)), '')), '')"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, max(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON f.html = p.html"""
