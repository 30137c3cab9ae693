"""Archives written and read back."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from merchgrid.llm import warc
from merchgrid.llm.common import shared_folder

ROWS = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>x</p>"), (4, "u", None), (5, "u v", ""), (6, "u", "long " * 100000), (7, "u", "<p>x</p>")]


def pages(spark):
    return spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark):
    got = {r.page_id: r for r in warc.archived(pages(spark)).collect()}
    assert len(got) == len(ROWS)
    for i, _, html in ROWS:
        payload = (html or "").encode()
        first = min(j for j, _, h in ROWS if (h or "") == (html or ""))
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.html == (html or "" if first == i else None)


def test_index_points_at_records_and_selection(spark):
    folder = shared_folder(spark)
    index = warc.write(warc.with_references(pages(spark)), folder, archive_bytes=200)
    assert index.select("file").distinct().count() > 3  # small archives are closed in time
    some = warc.read(index.where(F.col("page_id").isin(1, 6)), folder)
    assert sorted(r.page_id for r in some.collect()) == [1, 6]
    assert warc.with_references(pages(spark), min_revisit_bytes=5).where("refers_to is not null").count() == 2
    assert warc.archived(pages(spark).limit(0)).count() == 0


def test_damage_is_seen():
    good = warc.record(1, "u", b"abc", None, "2020-01-01T00:00:00Z")
    assert warc.parse(good)["html"] == "abc"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"abc", b"abd"))
