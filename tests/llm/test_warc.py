"""WARC archives: round trips through splits of every size."""

import gzip
import hashlib
import random
import zlib

import duckdb

from twinweave.llm import catalog, warc


def pages():
    rng = random.Random(6)
    noise = lambda n: "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900)])) for _ in range(n))
    big, edge, under = noise(3000), "x" * 1000, "x" * 999
    rows = [(i, "http://e.org/%d" % i, noise(rng.randrange(1500))) for i in range(25)]
    rows += [(100, "u", big), (103, "u\r\nX: y", big), (101, None, big), (50, "u", edge), (51, "u", edge), (60, "u", under), (61, "u", under),
             (70, "u", None), (71, "u", ""), (80, "u", "WARC/1.1\r\n\r\n" * 200), (103, "u", big), (None, "u", big), (None, "u", noise(2000)), (90, "u", "a" * 300_000)]
    return rows


def plain(rows):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "").encode() == raw]
        revisit = len(raw) >= 1000 and bool(same) and (i is None or i < max(same))
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_round_trip_over_split_sizes(spark):
    frame = spark.createDataFrame([(*r, "clash") for r in pages()], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write(frame, file_bytes=30_000)
    assert archives.count() >= 3
    for split in (97, 1000, 1 << 20):
        got = warc.read(archives, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(pages())
        payloads = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response" and r.page_id is not None}
        assert payloads[103] == next(h for i, _, h in pages() if i == 103).encode()
    for r in archives.collect():
        assert gzip.decompress(open(r.path.removeprefix("file:").replace("//", "/"), "rb").read()).count(b"WARC-Record-ID") >= r.records


def test_false_magic_and_nested_records_are_not_taken(tmp_path):
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    block = b"\x1f\x8b\x08" + inner + b"\x1f\x8b\x08\x00" + bytes(random.Random(1).randrange(256) for _ in range(4000))
    def member(level):
        press = zlib.compressobj(level, zlib.DEFLATED, 31)
        return press.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + press.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(member(0) + member(6) + member(0))
    size = path.stat().st_size
    for split in (50, 333, size):
        found = [(at, b) for s in range(0, size, split) for at, _, b in warc.records_in(str(path), s, min(size, s + split))]
        assert [at for at, _ in found] == [0, len(member(0)), len(member(0)) + len(member(6))]
        assert all(b == block for _, b in found)


def test_empty_table(spark):
    archives = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert archives.count() == 0 and warc.read(archives).count() == 0


def test_pages_without_id_as_in_the_sql(spark, tmp_path):
    big, other = "x" * 1500, "y" * 1200
    pages = spark.createDataFrame([(1, "u", big), (5, "u", big), (None, "u", big), (None, "u", other), (None, "u", other), (None, "u", None), (7, "u", "small"), (8, "u", "small")], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["op10_warc"]).fetchall(), key=str)
    got = sorted(map(tuple, catalog.QUERIES["op10_warc"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and sum(r[3] == "revisit" for r in got) == 2
