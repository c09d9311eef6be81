"""WARC archives: reading, writing, and the resolution of revisits.

Only headers are shuffled, by payload digest. A revisit is joined to the
earliest response with its digest; a response whose payload an earlier one
has becomes a revisit. Payloads stay where they were read, and the deduplicated archive is
written with fresh headers. Records of other types pass through as they are.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, local, shared_path, small

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
FIRST_CRAWL, SECOND_CRAWL = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"
_HTTP_TYPE = "application/http;msgtype=response"
_GZIP = b"\x1f\x8b\x08"
_READ, _LONGEST_HEAD = 1 << 18, 1 << 20


def base32_sha1(hexes: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexes)).decode()


def record_id(*of: Column) -> Column:
    """A UUID that depends only on what the record is, so a task that runs again gives the same."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)])


def resolve(headers: DataFrame) -> DataFrame:
    """The headers (record, warc_type, target_uri, warc_date, digest and any
    others) with: new_type ("response" or "revisit"), original (the record that holds the payload), original_uri and original_date.

    The original of a digest is its earliest response (ties: the least record). Responses
    with a null digest are their own originals. A revisit without an original has nulls there
    and new_type "unresolved". Rows of any other type, or none, keep it as new_type and have nulls.
    Repeated rows are resolved alike; other columns stay; an empty table gives no rows.
    """
    response, known = F.col("warc_type") == "response", F.col("warc_type").isin("response", "revisit")
    of_digest = Window.partitionBy("digest")
    found = F.min(F.when(response, F.struct("warc_date", "record", "target_uri"))).over(of_digest)
    found = F.when(known, F.when(F.col("digest").isNull(), F.when(response, F.struct("warc_date", "record", "target_uri"))).otherwise(found))
    h = headers.withColumn("_first", found)
    new = F.when(~F.coalesce(known, F.lit(False)), F.col("warc_type")).when(F.col("_first").isNull(), "unresolved").when(response & (F.col("_first.record") == F.col("record")), "response").otherwise("revisit")
    return h.withColumn("new_type", new).withColumns({"original": F.col("_first.record"), "original_uri": F.col("_first.target_uri"), "original_date": F.col("_first.warc_date")}).drop("_first")


def member(fields: list[tuple[str, str]], block: bytes, level: int = 3) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogateescape") + block + b"\r\n\r\n") + z.flush()


_MANIFEST = "record string, new_type string, target_uri string, warc_date string, digest string, original string, block_length long, archive string, offset long, length long"
_COLUMNS = ["record", "new_type", "target_uri", "warc_date", "digest", "original", "original_uri", "original_date", "http", "payload", "fields"]


#: Fields of responses and revisits that are made afresh; others stay as read.
_MADE = {"content-length", "content-type", "warc-type", "warc-record-id", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-block-digest", "warc-profile", "warc-refers-to", "warc-refers-to-target-uri", "warc-refers-to-date"}


def _line(x: str | None) -> str | None:
    """A header's value on one line."""
    return x.replace("\r", "%0D").replace("\n", "%0A") if x is not None else None


def _record(r: dict) -> tuple[list[tuple[str, str | None]], bytes]:
    """The header fields and the block of a row to be written."""
    kind, body = r["new_type"], r["payload"] or b""
    if kind not in ("response", "revisit", "unresolved"):
        # as it was read: its own fields in their order, its block untouched
        kept = [(f["name"], _line(f["value"])) for f in r["fields"] or [] if f["name"].lower() not in ("content-length", "warc-type", "warc-record-id")]
        return [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record']}>"), *kept], body
    head = r["http"] if r["http"] is not None else f"{HTTP}{len(body)}\r\n\r\n".encode()
    own = [(f["name"], _line(f["value"])) for f in r["fields"] or [] if f["name"].lower() not in _MADE]
    content = next((f["value"] for f in r["fields"] or [] if f["name"].lower() == "content-type"), _HTTP_TYPE)
    fields = [
        ("WARC-Type", "response" if kind == "response" else "revisit"), ("WARC-Record-ID", f"<{r['record']}>"), ("WARC-Target-URI", _line(r["target_uri"])), ("WARC-Date", r["warc_date"]),
        ("Content-Type", content), ("WARC-Payload-Digest", (base32_sha1(r["digest"]) if len(r["digest"]) == 40 else r["digest"]) if r["digest"] else None),
    ]
    if kind == "response":
        fields += [("WARC-Block-Digest", base32_sha1(hashlib.sha1(head + body).hexdigest()))]
        return fields + own, head + body
    to = r["original"]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{to}>" if to else None), ("WARC-Refers-To-Target-URI", _line(r["original_uri"])), ("WARC-Refers-To-Date", r["original_date"])]
    return fields + own, head


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes each partition of rows (record, new_type, target_uri, warc_date, digest, original,
    original_uri, original_date, http, payload, fields) as one archive in the shared folder; gives the
    manifest: what was written where. A file gets its name when it is whole, and a task that runs
    again writes the same bytes to the same name. `digest` is hexadecimal SHA-1 (anything else is written as it is); `http` is the
    head that stands before the payload (null: one is made); a null payload is empty. Revisits have their head alone,
    unresolved ones too. Records of other types are written with their own `fields` and their payload as block."""
    here = local(folder)
    os.makedirs(here, exist_ok=True)
    names = [x.split()[0] for x in _MANIFEST.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.string() for x in _MANIFEST.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{here}/{name}.{uuid.uuid4().hex}"
        at, any_rows = 0, False
        with open(part, "wb") as f:
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    r = {k: c[i].as_py() for k, c in zip(batch.schema.names, batch.columns)}
                    fields, block = _record(r)
                    data = member(fields, block)
                    f.write(data)
                    out.append((r["record"], r["new_type"], r["target_uri"], r["warc_date"], r["digest"], r["original"], len(block), name, at, len(data)))
                    at += len(data)
                if out:
                    any_rows = True
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)
        if any_rows:
            os.replace(part, f"{here}/{name}")
        else:
            os.remove(part)

    return rows.select(*_COLUMNS).mapInArrow(run, _MANIFEST)


# --- reading ---


class _Window:
    """Bytes of a stream that were read and not yet used; `at` is the offset of the first of them."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.done = stream, bytearray(), 0, False

    def more(self) -> bool:
        got = b"" if self.done else self.stream.read(_READ)
        self.done |= not got
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def find(self, mark: bytes, start: int, most: int) -> int:
        """Where a mark first lies, reading on up to `most` bytes; -1 if nowhere."""
        while True:
            i = self.held.find(mark, start)
            if i >= 0:
                return i
            start = max(start, len(self.held) - len(mark) + 1)
            if len(self.held) > most or not self.more():
                return -1


def _fields(head: bytes) -> list[tuple[str, str]]:
    """The fields of a header in their order; a folded line goes on."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def field(fields: list[tuple[str, str]], name: str) -> str | None:
    """The value of a field by its name in any case, or None."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _split(raw: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
    """Fields and block of a whole record, None if it isn't one."""
    head, mark, block = raw.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    fields = _fields(head)
    size = field(fields, "Content-Length")
    if size is None or not size.isdigit() or len(block) < int(size):
        return None
    return fields, bytes(block[: int(size)])


def records(stream) -> Iterator[tuple[int, list[tuple[str, str]] | None, bytes | str]]:
    """(offset, fields, block) of each record of an archive file, each record
    its own gzip member or none compressed, read piece by piece: memory holds one record at a time.

    Bytes that aren't a record (a damaged or cut off member, a head without its length) give one
    (offset, None, reason), and reading goes on at the next start of a member or record."""
    w = _Window(stream)
    while w.held or w.more():
        began = w.at
        if len(w.held) < 5:
            w.more()
        if w.held[:2] == b"\x1f\x8b":
            z, out, used, bad = zlib.decompressobj(31), [], 0, ""
            pieces, taken = w.held, 0
            try:
                while True:
                    out.append(z.decompress(pieces))
                    taken += len(pieces) - len(z.unused_data)
                    if z.eof:
                        used = taken
                        break
                    have = len(w.held)
                    if not w.more():
                        bad = "a member is cut off"
                        break
                    pieces = w.held[have:]
            except zlib.error as e:
                bad = f"a member is damaged: {e}"
            got = _split(b"".join(out)) if not bad else None
            if got:
                w.skip(used)
                yield began, *got
                continue
            bad, start, marks = bad or "a member is no record", used or 1, (_GZIP,)
        elif w.held.startswith(b"WARC/"):
            end = w.find(b"\r\n\r\n", 0, _LONGEST_HEAD)
            size = field(_fields(w.held[:end]), "Content-Length") if end >= 0 else None
            if size is not None and size.isdigit():
                whole = end + 4 + int(size)
                while len(w.held) < whole + 4 and w.more():
                    pass
                got = _split(w.held[:whole])
                if got:
                    w.skip(whole)
                    while w.held[:1] in (b"\r", b"\n") or (not w.held and w.more()):
                        w.skip(w.held[:1] in (b"\r", b"\n"))
                    yield began, *got
                    continue
            bad, start, marks = "a record is cut off or has no length", 5, (_GZIP, b"WARC/1")
        else:
            bad, start, marks = "no record begins here", 1, (_GZIP, b"WARC/1")
        yield began, None, bad
        # on to the next start, whichever kind comes first
        while True:
            found = [i for i in (w.held.find(m, start) for m in marks) if i >= 0]
            if found:
                w.skip(min(found))
                break
            drop = max(0, len(w.held) - 8)
            w.skip(drop)
            start = max(0, start - drop)
            if not w.more():
                w.skip(len(w.held))
                break


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each whole record of an archive's bytes; what isn't a record is passed over."""
    import io

    for _, fields, block in records(io.BytesIO(data)):
        if fields is not None:
            yield dict(fields), block


_RECORDS = "record string, warc_type string, target_uri string, warc_date string, digest string, refers_to string, http binary, payload binary, fields array<struct<name:string,value:string>>, archive string, offset long, damage string"


def _digest(d: str | None) -> str | None:
    """A payload digest in hexadecimal where it is base-32 SHA-1, else as it is."""
    x = (d or "").strip()
    if x.lower().startswith("sha1:") and len(x) == 37:
        try:
            return base64.b32decode(x[5:].upper()).hex()
        except ValueError:
            return x
    return x.removeprefix("sha1:") or None


def read_archives(spark: SparkSession, path: str, damaged: bool = False) -> DataFrame:
    """Records of the archive files of a folder or a pattern: record, warc_type, target_uri, warc_date,
    digest (hexadecimal), refers_to, http, payload, fields, archive, offset and damage.

    `http` is the head of an HTTP response or revisit with its blank line, as read (empty for another protocol's), and `payload` the bytes after it; other records
    have a null head and their whole block as payload; the payload of a revisit is null. Bytes stay what they are. What a header
    lacks is null. With `damaged`, each place that is no record gives a row too, with its reason in `damage`, so
    that nothing is lost unseen; without, such places are passed over. One task streams a file, a
    record at a time, so files of any size can be read. The folder has to be mounted on all machines."""
    names, schema = [x.split()[0] for x in _RECORDS.replace("array<struct<name:string,value:string>>", "f").split(", ")], _RECORDS
    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    types = [pa.binary() if n in ("http", "payload") else pair if n == "fields" else pa.int64() if n == "offset" else pa.string() for n in names]

    def clean(s: str | None) -> str | None:
        return s.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if s is not None else None

    def row(file: str, offset: int, fields, block) -> tuple:
        if fields is None:
            return (None, None, None, None, None, None, None, None, None, file, offset, block)
        kind = field(fields, "WARC-Type")
        kind = kind.lower() if kind else None
        http, payload = None, block
        if kind in ("response", "revisit") and block.startswith(b"HTTP/"):
            head, mark, payload = block.partition(b"\r\n\r\n")
            http = head + mark
        elif kind in ("response", "revisit"):
            http = b""  # another protocol's: no head
        refers = (field(fields, "WARC-Refers-To") or "").strip("<>") or None
        return (
            clean((field(fields, "WARC-Record-ID") or "").strip("<>")) or None, kind, clean(field(fields, "WARC-Target-URI")), clean(field(fields, "WARC-Date")), _digest(clean(field(fields, "WARC-Payload-Digest"))), clean(refers), http, payload if kind != "revisit" else None,
            [{"name": clean(k), "value": clean(v)} for k, v in fields], file, offset, None,
        )

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                with open(local(file), "rb") as f:
                    for offset, fields, block in records(f):
                        if fields is None and not damaged:
                            continue
                        held.append(row(file, offset, fields, block))
                        size += len(block)
                        if size > 8 << 20 or len(held) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return files.repartition("path").mapInArrow(run, schema)


def deduplicated(records: DataFrame, folder: str) -> DataFrame:
    """Resolves records (record, warc_type, target_uri, warc_date, digest,
    payload and, where they are there, http and fields) and writes the archive to `folder`; gives its manifest. Rows with a null record take no part; of rows that share one, all are
    written, but of equal revisits one. Records of other types, or none, are written as they are.

    Responses are written from where they are read: the few that become
    revisits are found by a join on the record's id and digest, broadcast while they are few. (A response without a digest never becomes one.)
    A payload that is a string counts as its UTF-8 bytes."""
    records = records.where("record is not null").withColumn("payload", F.col("payload").cast("binary"))
    lacks = {"http": F.lit(None).cast("binary"), "fields": F.lit(None).cast("array<struct<name:string,value:string>>")}
    records = records.withColumns({k: v for k, v in lacks.items() if k not in records.columns})
    kind = F.col("warc_type")
    headers = records.where(kind.isin("response", "revisit"))
    solved = cut(resolve(headers.select("record", "warc_type", "target_uri", "warc_date", "digest", *[F.when(kind == "revisit", F.col(c)).alias(c) for c in ("http", "fields")]).distinct()))
    seen = solved.where("warc_type = 'response' and new_type = 'revisit'").select("record", "digest", "original", "original_uri", "original_date").dropDuplicates(["record", "digest"])
    first = records.where("warc_type = 'response'").join(small(seen, seen.count()), ["record", "digest"], "left")
    first = first.withColumn("new_type", F.when(F.col("original").isNull(), "response").otherwise("revisit")).withColumn("original", F.coalesce("original", "record"))
    first = first.withColumn("payload", F.when(F.col("new_type") == "response", F.col("payload")))
    # a response that becomes a revisit keeps its own head, whose made-up form needs the payload's length
    again = solved.where("warc_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    nothing = F.lit(None).cast("string")
    other = records.where(F.coalesce(~kind.isin("response", "revisit"), F.lit(True))).withColumns({"new_type": F.coalesce(kind, F.lit("unknown")), "original": nothing, "original_uri": nothing, "original_date": nothing})
    return write_archives(first.select(*_COLUMNS).union(again.select(*_COLUMNS)).union(other.select(*_COLUMNS)), folder)


def crawl_log(pages: DataFrame) -> DataFrame:
    """Two crawls of the pages as records: a response for every page, and a
    later revisit that has only the payload's digest. A null html is an empty payload; a null
    page_id or url is kept."""
    digest = F.sha1(F.coalesce("html", F.lit("")))

    def part(kind: str, date: str, payload: Column) -> DataFrame:
        return pages.select(
            record_id(F.col("page_id"), F.lit(date), F.col("url")).alias("record"), F.lit(kind).alias("warc_type"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), digest.alias("digest"), payload.cast("binary").alias("payload")
        )

    return part("response", FIRST_CRAWL, F.coalesce("html", F.lit(""))).union(part("revisit", SECOND_CRAWL, F.lit(None)))


def resolve_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The manifest of the deduplicated archive of two crawls of the pages."""
    return deduplicated(crawl_log(pages), folder or shared_path(pages.sparkSession, "warc"))
