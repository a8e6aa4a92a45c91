"""WARC archives with a two-level capture index.

Pages are written as WARC 1.1 records, one gzip member each, into archives of bounded size below a
shared folder. A payload that occurs again is stored once; the other records are revisits that name
the stored one. The index holds one line per record, sorted by the URL key with its host reversed,
in compressed blocks of some thousand lines; a sparse directory keeps the first key and the place of
each block, and stands behind the blocks of its index file. A lookup searches the key ranges of the
index files, then the directory of a file, then a block, each by halves, and reads the record's bytes
from the archive. ``find`` does so for a table of keys, in tasks that hold the keys of one index file
in order; ``lookup`` for a few addresses.

A null payload is empty, a null URL is an empty key. Files are named at random and known only through
the tables written by the tasks that succeeded, so a repeated task leaves nothing that is read. The
folder is any address that pyarrow opens.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemark.llm.shared import cut, sorted_groups, with_arrow

#: Payloads below this size are always stored.
LEAST_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
DATE = "1970-01-01T00:00:00Z"
# Fixed value: the revisit profile of the standard.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes at the end of an index file that give the size of its directory.
_TAIL = 8
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

CAPTURES = "url_key string, page_id long, archive string, offset long, length long"
DIRECTORY = "first_key string, last_key string, file string, offset long, length long, n_lines long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_folder(address: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(address)
    return system, path.rstrip("/")


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the rest in lower-case host form."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").strip("."), parts.port
    except ValueError:
        return (url or "").strip()
    if not host:
        return (url or "").strip()
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _header_value(text: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool
) -> bytes:
    """One record before compression. A revisit keeps the HTTP header, with the full payload's size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case and the block; an error where lengths or marks do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_decisions(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows to write: payload, size, digest, and ``refers_to`` of those that repeat a payload.

    The record with the largest id is stored; rows that share that id are all stored.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload).alias("digest"),
    )
    again = rows.where(F.col("size") >= LEAST_SHARED).groupBy("digest")
    again = again.agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    joined = rows.join(again, "digest", "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"),
    )


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records; one capture line per record comes back as a stored table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        out, name, offset = None, "", 0
        for frame in frames:
            lines = []
            for page, url, payload, size, digest, refers, revisit in frame.itertuples(index=False):
                page = None if pd.isna(page) else int(page)
                refers = None if pd.isna(refers) else int(refers)
                data = gzip_member(record_bytes(page, url, payload or b"", digest, size, refers, revisit))
                if out is None or offset + len(data) > ARCHIVE_BYTES and offset:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                lines.append((url_key(url), page, name, offset, len(data)))
                offset += len(data)
            made = pd.DataFrame(lines, columns=["url_key", "page_id", "archive", "offset", "length"])
            yield made.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    columns = ["page_id", "url", "payload", "size", "digest", "refers_to", "revisit"]
    return cut(decided.select(*columns).mapInPandas(run, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort the captures into compressed blocks, each file's directory behind them; the directory of
    all files comes back as a stored table."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        system.create_dir(base, recursive=True)
        out, name, offset, lines, rows = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def close_block() -> None:
            nonlocal out, offset
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            data = gzip_member("".join(json.dumps(line) + "\n" for line in lines).encode())
            out.write(data)
            rows.append((lines[0][0], lines[-1][0], name, offset, len(data), len(lines)))
            offset += len(data)
            lines.clear()

        for frame in frames:
            for key, page, archive, at, length in frame.itertuples(index=False):
                lines.append([key, None if pd.isna(page) else int(page), archive, at, length])
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if out is not None:
            entries = "".join(json.dumps([first, last, at, n]) + "\n" for first, last, _, at, n, _ in rows)
            data = gzip_member(entries.encode())
            out.write(data + len(data).to_bytes(_TAIL, "little"))
            out.close()
        yield pd.DataFrame(rows, columns=["first_key", "last_key", "file", "offset", "length", "n_lines"])

    ordered = captures.select("url_key", "page_id", "archive", "offset", "length")
    ordered = ordered.orderBy("url_key", "page_id", "archive", "offset")
    return cut(ordered.mapInPandas(run, DIRECTORY), "directory")


def read_block(system: fs.FileSystem, path: str, offset: int, length: int) -> list[list]:
    with system.open_input_file(path) as file:
        data = zlib.decompress(file.read_at(length, offset), 31)
    return [json.loads(line) for line in data.decode().splitlines()]


def read_index(directory: DataFrame, folder: str) -> DataFrame:
    """All capture lines, read block by block by range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        for frame in frames:
            for row in frame.itertuples(index=False):
                lines = read_block(system, f"{base}/{row.file}", row.offset, row.length)
                made = pd.DataFrame(lines, columns=["url_key", "page_id", "archive", "offset", "length"])
                yield made.astype({"page_id": "Int64"})

    return directory.mapInPandas(run, CAPTURES)


class _IndexFile:
    """One index file: its directory, and the block read last."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        end = self.file.size() - _TAIL
        size = int.from_bytes(self.file.read_at(_TAIL, end), "little")
        self.blocks = self._lines(end - size, size)
        self.firsts, self.lasts = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self.at, self.lines, self.keys = -1, [], []

    def _lines(self, offset: int, length: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset), 31).decode().splitlines()]

    def find(self, key: str) -> Iterator[list[list]]:
        """The lines of a key, block by block."""
        for at in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            if at != self.at:
                self.at, self.lines = at, self._lines(*self.blocks[at][2:])
                self.keys = [line[0] for line in self.lines]
            yield self.lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]


def keys_of(pages: DataFrame, url: str = "url") -> DataFrame:
    """The different URL keys of a table, column ``url_key``."""
    field = T.StructField("url_key", T.StringType())
    named = with_arrow(pages.select(url), [url], lambda urls: [[url_key(u) for u in urls]], [field])
    return named.select("url_key").distinct()


def find(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """The capture lines of all ``url_key``; a key must occur once.

    The driver holds one key range per index file, at most ``spark.sql.shuffle.partitions`` of them. A
    key whose captures fill several files is looked up in each of them by another task.
    """
    tops = directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b"))
    files = sorted((r["a"], r["b"], r["file"]) for r in tops.collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (files[i][2], key) for key in frame["url_key"]
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key))
            ]
            yield pd.DataFrame(rows, columns=["file", "url_key"])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        name, index, found = None, None, []

        def made() -> pd.DataFrame:
            frame = pd.DataFrame(found, columns=["url_key", "page_id", "archive", "offset", "length"])
            found.clear()
            return frame.astype({"page_id": "Int64"})

        for frame in frames:
            for file, key in zip(frame["file"], frame["url_key"]):
                if file != name:
                    name, index = file, _IndexFile(system, f"{base}/{file}")
                for lines in index.find(key):
                    found += lines
                    if len(found) >= 10_000:
                        yield made()
        yield made()

    placed = keys.select("url_key").mapInPandas(place, "file string, url_key string")
    dealt = placed.repartition("file").sortWithinPartitions("file", "url_key")
    return dealt.mapInPandas(search, CAPTURES)


def record_row(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """The checked content of a record: id, payload size and digest, type, and what it refers to."""
    fields, block = parse_record(zlib.decompress(data, 31))
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its digest")
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return page and int(page), size, digest, kind, refers and int(refers)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Read every listed record by range, one archive after the other in order of place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = open_folder(folder)
        for group in sorted_groups(frames, "archive"):
            with system.open_input_file(f"{base}/{group['archive'].iloc[0]}") as file:
                rows = [record_row(file.read_at(n, at)) for at, n in zip(group["offset"], group["length"])]
            made = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = captures.select("archive", "offset", "length").repartition("archive")
    return dealt.sortWithinPartitions("archive", "offset").mapInPandas(run, RECORDS)


def lookup(spark: SparkSession, directory: DataFrame, index: str, archives: str, urls: Iterable[str]) -> list[dict]:
    """Records of some URLs: bisect the directory, read the blocks that can hold the key, bisect
    these, and read the records. The directory has one row per block and is held in memory."""
    blocks = directory.orderBy("first_key", "last_key").collect()
    firsts, found = [b["first_key"] for b in blocks], []
    (isys, ibase), (asys, abase) = open_folder(index), open_folder(archives)
    for url in urls:
        key = url_key(url)
        at = bisect_right(firsts, key) - 1
        while at >= 0 and blocks[at]["last_key"] >= key:
            block = blocks[at]
            lines = read_block(isys, f"{ibase}/{block['file']}", block["offset"], block["length"])
            end = bisect_right([line[0] for line in lines], key)
            while end and lines[end - 1][0] == key:
                end -= 1
                _, _, archive, offset, length = lines[end]
                with asys.open_input_file(f"{abase}/{archive}") as file:
                    fields, content = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                found.append({"url": url, "fields": fields, "payload": content.partition(b"\r\n\r\n")[2]})
            if block["first_key"] < key:
                break
            at -= 1
    return found


def archive(pages: DataFrame, archives: str, index: str) -> tuple[DataFrame, DataFrame]:
    """Write archives and index: ``(captures, directory)``."""
    captures = write_archives(with_decisions(pages), archives)
    return captures, write_index(captures, index)
