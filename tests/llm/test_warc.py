import hashlib
import uuid

import pytest

from tonemark.llm import warc as ops


def pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    from pyspark.sql import functions as F

    return df.withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))


def want(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        again = len(data) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1 and page != first
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://www.h{i % 7}.example.com:80{i % 3}/a b/{i}?q=é", "x" * (900 + i % 4 * 40) + "é" * (i % 5)) for i in range(120)]
ROWS += [(200, None, None), (201, "", ""), (202, "no host", "\r\n\r\nWARC/1.1\r\n"), (203, "http://[bad", "y" * 2000)]
ROWS += [(203, "http://h/\nnew", "y" * 2000), (100, "http://h/", "y" * 2000), (None, "http://h/", "y" * 2000), (300, "http://h1.example.com/z", "é" * 600)]


@pytest.fixture
def folders(tmp_path):
    return f"file://{tmp_path}/archives", f"file://{tmp_path}/index"


@pytest.mark.parametrize("block, archive", [(1000, 64 << 20), (5, 3000)])
def test_round_trip_through_archives_and_index(spark, folders, monkeypatch, block, archive):
    monkeypatch.setattr(ops, "BLOCK_LINES", block)
    monkeypatch.setattr(ops, "ARCHIVE_BYTES", archive)
    captures, directory = ops.archive(pages(spark, ROWS), *folders)
    read = ops.read_records(ops.read_index(directory, folders[1]), folders[0])
    assert sorted((tuple(r) for r in read.collect()), key=str) == want(ROWS)
    blocks = directory.orderBy("first_key").collect()
    assert sum(b["n_lines"] for b in blocks) == len(ROWS) and all(b["n_lines"] <= block for b in blocks)
    assert all(a["last_key"] <= b["first_key"] for a, b in zip(blocks, blocks[1:]))
    urls = [ROWS[3][1], "http://h/", "http://nowhere.example/", "http://h1.example.com/z"]
    found = ops.lookup(spark, directory, folders[1], folders[0], urls)
    got = sorted((f["url"], f["fields"]["warc-type"]) for f in found)
    assert got == sorted([(ROWS[3][1], "revisit"), ("http://h/", "revisit"), ("http://h/", "revisit"), (urls[3], "response")])
    assert [f["payload"].decode() for f in found if f["url"] == urls[3]] == ["é" * 600]


def test_empty_table(spark, folders):
    _, directory = ops.archive(pages(spark, []), *folders)
    assert ops.read_records(ops.read_index(directory, folders[1]), folders[0]).count() == 0
    assert ops.lookup(spark, directory, folders[1], folders[0], ["http://h/"]) == []


def test_url_keys():
    assert ops.url_key("HTTP://WWW.Example.com/A?b=C") == "com,example,www)/A?b=C"
    assert ops.url_key("http://example.com:8080") == "com,example:8080)/"
    assert ops.url_key(None) == "" and ops.url_key("no host") == "no host"


def test_damage_is_noticed():
    payload = b"p" * 50
    data = ops.record_bytes(1, "http://h/", payload, hashlib.sha1(payload).hexdigest(), 50, None, False)
    assert ops.record_row(ops.gzip_member(data)) == (1, 50, hashlib.sha1(payload).hexdigest(), "response", None)
    for bad in (data.replace(b"ppp", b"pqp", 1), data[:-1], data.replace(b"WARC/1.1", b"XARC/1.1", 1)):
        with pytest.raises(ValueError):
            ops.record_row(ops.gzip_member(bad))
    assert uuid.UUID(ops._record_id(1)[10:-1]).version == 5


@pytest.mark.parametrize("block", [1000, 5, 1])
def test_every_capture_is_found_by_its_key(spark, folders, monkeypatch, block):
    monkeypatch.setattr(ops, "BLOCK_LINES", block)
    # one address holds a third of all rows and fills blocks and files of its own
    rows = ROWS + [(1000 + i, "http://hot.example/", f"{i}") for i in range(60)]
    table = pages(spark, rows)
    _, directory = ops.archive(table, *folders)
    keys = ops.keys_of(table)
    assert keys.count() == len({ops.url_key(url) for _, url, _ in rows})
    read = ops.read_records(ops.find(keys, directory, folders[1]), folders[0])
    assert sorted((tuple(r) for r in read.collect()), key=str) == want(rows)
    some = spark.createDataFrame([("example,hot)/",), ("nowhere)/",), ("",)], "url_key string")
    got = sorted((r["page_id"] for r in ops.find(some, directory, folders[1]).collect()))
    assert got == [200, 201, *range(1000, 1060)]


def test_search_relies_on_the_order_of_the_directory(spark, folders, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK_LINES", 5)
    table = pages(spark, ROWS)
    _, directory = ops.archive(table.coalesce(1), *folders)
    plain = ops._IndexFile

    class Shuffled(plain):
        def __init__(self, system, path):
            super().__init__(system, path)
            self.blocks.reverse()
            self.firsts, self.lasts = [b[0] for b in self.blocks], [b[1] for b in self.blocks]

    file = directory.groupBy("file").count().orderBy("count", ascending=False).first()
    assert file["count"] > 2
    system, base = ops.open_folder(folders[1])
    keys = sorted({ops.url_key(url) for _, url, _ in ROWS})
    counts = [sum(len(x) for k in keys for x in kind(system, f"{base}/{file['file']}").find(k)) for kind in (plain, Shuffled)]
    lines = sum(r["n_lines"] for r in directory.where(directory.file == file["file"]).collect())
    assert counts[0] == lines and counts[1] < lines


def test_find_in_an_empty_index(spark, folders):
    _, directory = ops.archive(pages(spark, []), *folders)
    some = spark.createDataFrame([("example,hot)/",)], "url_key string")
    assert ops.find(some, directory, folders[1]).count() == 0
