import random

import pytest

from chalkline.llm import warc

ROWS = [
    (5, "http://a/", "<p>same</p>"),
    (2, "http://b/\r\nX: 1", "<p>same</p>"),
    (9, None, None),
    (1, "http://é/", ""),
    (7, "u", "ä\r\n\r\nWARC/1.1\r\n" * 3),
    (8, "long", "x y" * 400_000),
    (8, "long", "x y" * 400_000),
    (None, "none", "<p>same</p>"),
    (None, "none", "alone"),
    *[(100 + i, "f", f"page {i} " * 500) for i in range(60)],
]


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'s' AS sha", "2 AS nth")
    return warc.write_archives(pages, warc.shared_folder(spark, "t"), frame_bytes=20_000, archive_bytes=50_000).cache()


def test_round_trip(index):
    got = warc.read_archives(index).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, _, h in ROWS:
        groups.setdefault(h or "", []).append(i)
    want = []
    for h, ids in groups.items():
        known = sorted(ids, key=lambda i: (i is None, i))
        data = h.encode()
        want += [(i, len(data), warc.digest(data), *(("response", None) if k == 0 else ("revisit", known[0]))) for k, i in enumerate(known)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))


def test_index_leads_to_one_frame_with_the_whole_payload(index):
    rows = index.collect()
    assert len({r.archive for r in rows}) > 1 and max(r.frame for r in rows) > 0 and max(r.frame_offset for r in rows) > 0
    texts = {i: h or "" for i, _, h in ROWS if i is not None}
    for r in random.Random(1).sample(rows, 20):
        headers, block = warc.read_one(r.archive, r.frame, r.frame_offset)
        assert headers["WARC-Record-ID"] == r.record_id
        if headers["WARC-Type"] == "response" and r.page_id is not None:
            assert block.partition(b"\r\n\r\n")[2].decode() == texts[r.page_id]


def test_archives_are_plain_zstandard(index):
    import io

    import zstandard

    name = index.first().archive
    files, path = warc.open_folder(name)
    with files.open_input_file(path) as f:
        data = f.read()
        frames = warc.seek_table(f)
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(whole) == sum(n for _, _, n in frames) and whole.startswith(b"WARC/1.1")


def test_small_payloads_all_answer(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, warc.shared_folder(spark, "t"), least_bytes=2)).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, warc.shared_folder(spark, "t"))).count() == 0
