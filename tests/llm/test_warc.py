import base64
import gzip
import hashlib
import io
import os

import pytest

from quarryline.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first long"
ROWS = [
    (5, "http://a/ü b", "same", "p", 1),
    (3, "http://b", "same", "p", 1),
    (3, "http://b", "same", "p", 1),
    (9, None, "same", "p", 1),
    (1, "http://c", None, "p", 1),
    (2, "http://d\r\nX: y", "", "p", 1),
    (7, "http://e", "long é🙂 " * 20_000, "p", 1),
    (None, "http://f", "no id", "p", 1),
    (-4, "http://g", "negative\r\n\r\nWARC/1.1", "p", 1),
    (3, "http://b", "another", "p", 1),
]


def want(rows, least):
    first = {}
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if page_id is not None and len(data) >= least:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        one = first.get(data)
        revisit = one is not None and one != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", one if revisit else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    to = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(pages, to, least, roll_bytes=200)
    listed = sorted(manifest.collect())
    assert sum(m.records for m in listed) == len(ROWS) and len(listed) > 3
    got = warc.read_archives(spark, to, manifest).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == want(ROWS, least)
    texts = {(r[0], r[2] or "") for r in ROWS}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.record_type == "response")
    assert not os.path.exists(tmp_path / "archives/temporary")
    for m in listed:
        data = (tmp_path / "archives" / m.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (m.bytes, m.sha256)
    assert os.path.exists(tmp_path / "archives/manifest/_SUCCESS")


def test_renaming_again_does_no_harm(spark, tmp_path):
    (tmp_path / "temporary").mkdir()
    (tmp_path / "temporary/x").write_bytes(b"data")
    files = spark.createDataFrame([(0, 0, f"{tmp_path}/temporary/x", 1, 4, "h")], "shard int, roll int, at string, records long, bytes long, sha256 string")
    for _ in range(2):
        assert warc.committed(files, f"file://{tmp_path}").collect() == [("pages-000000-000000.warc.gz", 1, 4, "h")]
    assert (tmp_path / "pages-000000-000000.warc.gz").read_bytes() == b"data"


def test_same_files_from_any_partitioning(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    made = []
    for n in (1, 7):
        to = f"file://{tmp_path}/{n}"
        made.append(warc.write_archives(pages.repartition(n), to, 0, roll_bytes=1 << 30).orderBy("name").collect())
    content = [b"".join(gzip.open(tmp_path / str(n) / m.name).read() for m in x) for n, x in zip((1, 7), made)]
    assert content[0] == content[1]
    assert [h["warc-type"] for h, _ in warc.records_in(io.BytesIO(content[0]))].count("revisit") == 3


def test_record_ids_hold_page_ids():
    for page_id in (0, 1, -1, 2**63 - 1, -(2**63), 2**62, None, -(2**62) - 5):
        assert warc.page_of(warc.record_id(page_id)) == page_id


def test_empty(spark, tmp_path):
    to = f"file://{tmp_path}/none"
    manifest = warc.write_archives(spark.createDataFrame([], SCHEMA), to)
    assert manifest.isEmpty() and warc.read_archives(spark, to, manifest).count() == 0
