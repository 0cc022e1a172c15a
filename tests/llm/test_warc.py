import gzip
import hashlib
import io

import pytest

from oddrows.llm import warc
from oddrows.llm.common import scratch_path

HTML = "<p>" + "x" * 120 + "</p>"
ROWS = [
    (5, "http://a", HTML, "q"), (3, "http://b\r\nX: 1", HTML, "q"), (3, "http://b", HTML, "q"), (9, None, None, "q"), (None, "http://c", HTML, "q"), (11, "http://d%0D", "", None),
    (12, "http://e", "short", "q"), (13, "http://f", "short", "q"), (14, "http://g", "é" * 60, "q"), (15, "http://h", "a\r\n\r\nb\u0000" * 300_000, "q"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string").repartition(3)


@pytest.mark.parametrize("split", [7, 1000, 1 << 20])
def test_round_trip_at_any_split(spark, pages, split):
    if split == 7:
        pages = pages.where("length(coalesce(html, '')) < 1000")
    got = warc.warc_round_trip(pages, split_bytes=split).collect()
    assert len(got) == pages.count()
    rows = [r for r in ROWS if split > 7 or len(r[2] or "") < 1000]
    key = lambda t: tuple(map(repr, t))
    want = []
    for page_id, url, html, _ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        refers = first if first is not None and page_id is not None and first != page_id else None
        want.append((page_id, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    have = [(r["page_id"], r["url"], r["payload_length"], hashlib.sha256(r["payload"]).hexdigest() if r["payload"] is not None else r["digest"], r["record_type"], r["refers_to"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_archives_are_plain_gzip_members(spark, pages):
    manifest = warc.write_warc(warc.plan_records(pages), scratch_path(spark, "t")).collect()
    assert sum(r["records"] for r in manifest) == len(ROWS)
    with open(manifest[0]["path"].removeprefix("file:"), "rb") as f:
        data = f.read()
    assert len(data) == manifest[0]["bytes"] and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_false_magic_is_no_record():
    real = warc.encode_record(1, "u", b"payload", "d", None, "2000-01-01T00:00:00Z", 6)
    inner = gzip.compress(b"not a header")
    data = warc.MAGIC + b"junk" + inner + real + b"\x1f\x8b" + real[:20]
    found = list(warc.read_range(io.BytesIO(data), 0, len(data)))
    assert [h["page-id"] for h, _ in found] == ["1"]
    cuts = [list(warc.read_range(io.BytesIO(data), a, a + 1)) for a in range(len(data))]
    assert sum(map(len, cuts)) == 1


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(none).count() == 0
