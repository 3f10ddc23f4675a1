"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response gives one `metadata` record (title, language, outlinks, the source's status line and headers, the id of the
conversion) and one `conversion` record (the visible text). Both keep the response's id in WARC-Refers-To, its target and
date, its HTTP header block and its payload digest; ids are derived from the response's id, so reruns give the same ones.

A page is read in one pass from left to right, in time and memory in proportion to its length whatever it holds; very long pages
are held whole by one task. Text outside tags is kept in whole, entities resolved; comments go, and so do scripts, styles and the
like that are closed. A comment that is never closed hides what follows it.

Null urls give an empty target, null or empty bodies empty texts, null headers an empty block. Responses that repeat an id
give records that repeat; there are no ties to break. An empty table gives no record, and files of none. Of other columns none
is read, whatever they are called. Files are written and read through Spark's own writers and readers, so any path of Spark
will do; control characters never reach a header as they are.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import lean

DATE = "2024-01-01T00:00:00Z"
#: Elements whose content is not text; those that begin and end a line.
RAW = ("script", "style", "noscript", "template")
BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_CLOSE = {x: re.compile(rf"(?i)</{x}\s*>") for x in (*RAW, "title")}
_LANG = re.compile(r"""(?i)(?<![^\s"'])lang\s*=\s*["']?([\w-]+)""")
_HREF = re.compile(r"""(?i)(?<![^\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_MARK = re.compile("[>\"']")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_CONTROL = re.compile("[\x00-\x1f\x7f]")


class _Ends:
    """Where things end in a page. What is not found once isn't looked for again further on, so all searches together are linear."""

    def __init__(self, page: str):
        self.page, self.next, self.dead, self.first = page, {}, set(), -1

    def find(self, what: str, at: int) -> int:
        """The first place of `what` from `at` on, which never goes back; the page's length if there is none."""
        found = self.next.get(what, -1)
        if found < at:
            found = self.page.find(what, at)
            found = self.next[what] = len(self.page) if found < 0 else found
        return found

    def close(self, name: str, at: int) -> re.Match | None:
        """The closing tag of an element from `at` on."""
        if ("close", name) in self.next:
            return None
        found = _CLOSE[name].search(self.page, at)
        if found is None:
            self.next["close", name] = 0
        return found

    def tag(self, at: int) -> int:
        """Where the tag that begins at `at` ends: behind a > outside quotes, or the next > before any <; -1 if it is none."""
        if self.first <= at:
            m = _MARK.search(self.page, at + 1)
            self.first = m.start() if m else len(self.page)
        seen, i = [], self.first
        while i < len(self.page) and i not in self.dead:
            seen.append(i)
            if self.page[i] == ">":
                return i + 1
            close = self.page.find(self.page[i], i + 1)
            m = _MARK.search(self.page, close + 1) if close >= 0 else None
            i = m.start() if m else len(self.page)
        # Whoever comes to one of these marks outside quotes finds no end either.
        self.dead.update(seen)
        end = self.find(">", at + 1)
        return end + 1 if end < min(self.find("<", at + 1), len(self.page)) else -1


def scanned(page: str) -> tuple[list[str], str | None, str | None, list[str]]:
    """(parts of the visible text, the title, the language, the links) of a page."""
    ends, parts, title, lang, links, at = _Ends(page), [], None, None, [], 0
    while at < len(page):
        start = ends.find("<", at)
        parts.append(page[at:start])
        if start == len(page):
            break
        if page.startswith("<!--", start):
            at = ends.find("-->", start + 4) + 3
            parts.append(" ")
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        end = ends.tag(start) if name or page.startswith(("/", "!", "?"), start + 1) else -1
        if end < 0:
            parts.append("<")
            at = start + 1
            continue
        at = end
        if not name:
            continue
        kind = name[0].lower()
        if kind in BLOCKS:
            parts.append("\n")
        if closing:
            continue
        if kind in RAW:
            if close := ends.close(kind, at):
                parts.append(" ")
                at = close.end()
        elif kind == "title" and title is None:
            if close := ends.close(kind, at):
                title = page[at : close.start()]
        elif kind == "html" and lang is None:
            found = _LANG.search(page, name.end(), end)
            lang = found and found[1]
        elif kind == "a":
            if found := _HREF.search(page, name.end(), end):
                links.append(next((x for x in found.groups() if x is not None), ""))
    return parts, title, lang, links


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def lines(parts: list[str]) -> str:
    page = "".join(parts)
    found = (_SPACE.sub(" ", x).strip() for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in found if x)


def visible(page: str) -> str:
    """The text outside tags, a line for each block."""
    return lines(scanned(page)[0])


def escaped(value: str) -> str:
    """A header's value without control characters, each of which becomes % and two digits."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """pages (page_id, url, html) as response records: page_id, record_id, target_uri, warc_date, http_headers, payload."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(payload).cast("string"), F.lit("\r\n"))
    h = F.md5(F.concat_ws("\x00", F.col("page_id").cast("string"), F.col("url"), F.sha2(payload, 256)))
    name = F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, i, n), F.lit("-" if i < 21 else ">"))])
    return pages.select("page_id", name.alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"), payload.alias("payload"))


SCHEMA = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "http_headers string, source_payload_digest string, block_digest string, content_length long, block binary"
)


def derived(source: dict) -> Iterator[dict]:
    """The metadata and the conversion record of a response."""
    payload, headers, target = source["payload"] or b"", source["http_headers"] or "", source["target_uri"] or ""
    refers = source["record_id"] or ""
    page = payload.decode("utf-8", "replace")
    ids = {kind: record_id(kind, refers) for kind in ("metadata", "conversion")}
    parts, title, lang, links = scanned(page)
    one_line = lambda s: escaped(" ".join(html.unescape(s).split()))
    fields = [("derived-conversion", ids["conversion"])]
    fields += [(k, x) for k, x in (("title", title and one_line(title)), ("language", lang)) if x is not None]
    fields += [("source-header", escaped(x)) for x in headers.split("\r\n") if x]
    fields += [("outlink", one_line(x)) for x in links]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")),
        "conversion": ("text/plain", lines(parts).encode("utf-8", "surrogatepass")),
    }
    for kind, (content_type, block) in blocks.items():
        yield {
            "page_id": source["page_id"], "warc_type": kind, "record_id": ids[kind], "refers_to": refers, "target_uri": target, "warc_date": source["warc_date"] or "",
            "content_type": content_type, "http_headers": headers, "source_payload_digest": digest(payload), "block_digest": digest(block), "content_length": len(block), "block": block,
        }


def derive(source: DataFrame) -> DataFrame:
    """Response records -> two records each, with the columns of SCHEMA."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
                yield pa.RecordBatch.from_pylist([x for row in part.to_pylist() for x in derived(row)], schema)

    need = ("page_id", "record_id", "target_uri", "warc_date", "http_headers", "payload")
    return source.select(F.col("page_id").cast("long").alias("page_id"), *need[1:]).mapInArrow(lean(run), SCHEMA)


VERSION = "WARC/1.1"
#: How a record ends, and the header that holds, in base 64, what another one could only hold escaped.
END = b"\r\n\r\n"
_WHOLE = "X-Whole-"


def serialized(record: dict) -> bytes:
    """A record as WARC/1.1, without its end."""
    plain = {
        "WARC-Type": record["warc_type"], "WARC-Record-ID": record["record_id"], "WARC-Refers-To": record["refers_to"], "WARC-Target-URI": record["target_uri"], "WARC-Date": record["warc_date"],
        "WARC-Block-Digest": record["block_digest"], "X-Source-Payload-Digest": record["source_payload_digest"],
        "X-Source-Headers": base64.b64encode(record["http_headers"].encode("utf-8", "surrogatepass")).decode(),
        "X-Page-ID": "" if record["page_id"] is None else str(record["page_id"]), "Content-Type": record["content_type"], "Content-Length": str(len(record["block"])),
    }
    head = {}
    for k, v in plain.items():
        head[k] = escaped(v)
        if head[k] != v or v != v.strip():
            head[_WHOLE + k] = base64.b64encode(v.encode("utf-8", "surrogatepass")).decode()
    return (f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogatepass") + record["block"]


def _headers(data: bytes) -> dict[str, str]:
    """The header fields of the lines before a block, those that are held whole as they were."""
    head = {}
    for line in data.split(b"\r\n"):
        k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
        if k:
            head[k] = v.strip()
    for k in [x for x in head if x.startswith(_WHOLE)]:
        head[k[len(_WHOLE) :]] = base64.b64decode(head.pop(k)).decode("utf-8", "surrogatepass")
    return head


def parsed(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of each record of a WARC file, gzipped in one or more members or not."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        parts.append(d.decompress(data))
        data = d.unused_data
    f = io.BytesIO(b"".join(parts) if parts else data)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = []
        while (line := f.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        fields = _headers(b"\r\n".join(head))
        yield fields, f.read(int(fields["Content-Length"]))


def write_warc(records: DataFrame, folder: str, per_file: int = 100_000) -> DataFrame:
    """Writes gzipped WARC files into a folder, whatever it held before; returns path, records and bytes of each.

    Spark's text writer writes them: it puts bytes as they are, a record's end after each row, and a file appears when it is whole,
    with the others of its job. A file holds at most per_file records.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"record": pa.array([serialized(row) for row in b.to_pylist()], pa.binary())})

    rows = records.select(*names).mapInArrow(lean(run), "record binary").select(F.col("record").cast("string").alias("value"))
    rows.write.mode("overwrite").options(maxRecordsPerFile=per_file).text(folder, compression="gzip", lineSep=END.decode())
    spark = records.sparkSession
    name = F.element_at(F.split("path", "/"), -1).alias("name")  # the readers write paths in different ways
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", name, F.col("length").alias("bytes"))
    counts = read_warc(spark, folder).groupBy(name).agg(F.count("*").alias("records"))
    return files.join(counts, "name", "left").select("path", F.coalesce("records", F.lit(0)).alias("records"), "bytes")


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """path, the records' headers as columns and the block of the records of WARC files, plain or gzipped, at a path Spark can read.

    Files are streamed, not held whole: Spark's text reader cuts them where the version's line stands. A cut within a block, which
    may hold that line as well, shows by the block's length and is mended. A gzipped file is one task's; a plain one is cut into
    several only if none of its blocks could be told from a record, so plain files are read whole instead, up to 2 GB each.
    """
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest"}
    schema = pa.schema([(k, pa.string()) for k in ("path", *names)] + [("block", pa.binary())])
    ddl = ", ".join(f"{k} string" for k in ("path", *names)) + ", block binary"
    line = f"{version}\r\n"

    def row(path: str, head: dict, block: bytes) -> dict:
        return {"path": path} | {k: head.get(v) for k, v in names.items()} | {"block": block}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, need = None, b"", 0
        for b in batches:
            out = []
            for where, value in zip(b.column("path").to_pylist(), b.column("value"), strict=True):
                value = value.as_py()
                if where != now:
                    if held:
                        raise ValueError(f"{now} ends within a record")
                    now = where
                    if not value:  # before the first record
                        continue
                held = held + line.encode() + value if held else value
                if len(held) < need:
                    continue
                at = held.find(END)
                head = _headers(held[: at + 2]) if at >= 0 else {}
                if "Content-Length" not in head:
                    raise ValueError(f"{where} holds what is not a record of {version}")
                need = at + 4 + int(head["Content-Length"])
                if len(held) >= need:
                    out.append(row(where, head, held[at + 4 : need]))
                    held, need = b"", 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            raise ValueError(f"{now} ends within a record")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                found = [row(where, *x) for x in parsed(content.as_py())]
                yield pa.RecordBatch.from_pylist(found, schema)

    files = spark.read.format("binaryFile").load(path).select("path")
    zipped = F.col("path").endswith(".gz")
    kinds = {r["zipped"] for r in files.select(zipped.alias("zipped")).distinct().collect()}
    texts = spark.read.option("lineSep", line).option("pathGlobFilter", "*.gz").text(path) if True in kinds else None
    parts = []
    if texts is not None:
        texts = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
        parts.append(texts.mapInArrow(lean(cut), ddl))
    if False in kinds:
        plain = spark.read.format("binaryFile").load(path).where(~zipped).select("path", "content")
        parts.append(plain.mapInArrow(lean(whole), ddl))
    if not parts:
        return spark.createDataFrame([], ddl)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
