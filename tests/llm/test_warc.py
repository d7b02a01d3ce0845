"""Archives: round trip through a monolithic stream, revisits, index."""

import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from legalspark.llm import warc

PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b\r\nX: y", None), (4, "u", ""), (5, "u", "long " * 200_000), (None, "u", "<p>é</p>"), (6, "u", "one"), (6, "u", "one"), (7, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n")]


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        to = max(same) if same and len(data) >= least and i is not None and i < max(same) else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    assert sorted((tuple(r) for r in warc.archive(pages).collect()), key=str) == brute(PAGES)
    assert sorted((tuple(r) for r in warc.archive(pages, least=1).collect()), key=str) == brute(PAGES, 1)
    assert warc.archive(pages.limit(0)).count() == 0


def test_damaged_archives_are_errors(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"x" * 500).digest()).decode()
    records = [warc.record(k, "u", b"x" * 500, digest, None) for k in range(40)]
    whole = gzip.compress(b"".join(records))
    cut = zlib.compressobj(6, zlib.DEFLATED, 31)
    between = cut.compress(b"".join(records[:20])) + cut.flush(zlib.Z_SYNC_FLUSH)  # ends between records, not with a member
    for name, data in (("half", whole[: len(whole) // 2]), ("between", between)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            warc.normalise(f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}.out")
    (tmp_path / "good").write_bytes(whole)
    warc.normalise(f"file://{tmp_path}/good", f"file://{tmp_path}/good.gz")
    with pytest.raises(Exception, match="40 of 41 records"):
        warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/good.gz", 41)], "path string, records long"))


def test_monolithic_streams_become_members(tmp_path):
    records = [warc.record(k, f"http://x/{k}", b"p" * (k * 1000), "D" * 32, k + 1 if k % 2 else None) for k in range(50)]
    whole = gzip.compress(b"".join(records[:30])) + gzip.compress(b"".join(records[30:]))
    (tmp_path / "in.gz").write_bytes(whole)
    assert warc.normalise(f"file://{tmp_path}/in.gz", f"file://{tmp_path}/out.gz") == 50
    data, index = (tmp_path / "out.gz").read_bytes(), [json.loads(x) for x in (tmp_path / "out.gz.idx").read_text().splitlines()]
    assert gzip.decompress(data) == b"".join(records)
    assert [gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]) for e in index] == records
    head, http, payload = warc.read_member(io.BytesIO(data), index[20]["offset"], index[20]["length"])
    assert head["warc-record-id"] == "<urn:page:20>" and payload == b"p" * 20_000 and http["content-length"] == "20000"
