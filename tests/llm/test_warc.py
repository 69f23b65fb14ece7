import gzip
import random
import re
import time

import pytest

from triage.llm import warc as W
from triage.llm.queries import op8_warc

SF = "/root/testdata/sf0.001"


def make(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = rng.randbytes(rng.randint(0, 400)) + b"WARC/1.1\r\n" * (i % 5 == 0)
        out.append((i, payload, W.record(i, f"http://x/{i}", payload, W.digest_of(payload), None, "2024-01-01T00:00:00Z")))
    return out


def ids(found):
    """Ids of the records; -1 where a damaged header holds none."""
    names = [re.fullmatch(r"<urn:page:(\d+)>", f.headers["warc-record-id"]) for f in found if f.reason is None]
    return [int(m[1]) if m else -1 for m in names]


def lost(found):
    return [(f.offset, f.offset + f.length) for f in found if f.reason]


@pytest.mark.parametrize("packed", [True, False])
def test_records_behind_damage_are_recovered(packed):
    rng = random.Random(7)
    rows = make(30)
    parts = [gzip.compress(r, mtime=0) if packed else r for _, _, r in rows]
    starts = [sum(map(len, parts[:i])) for i in range(31)]
    whole = b"".join(parts)
    found = list(W.salvage(whole))
    assert ids(found) == list(range(30)) and not lost(found)
    assert [f.payload for f in found] == [p for _, p, _ in rows]
    for _ in range(40):
        data = bytearray(whole)
        hit = sorted(rng.sample(range(30), 3))
        for k in hit:
            at = rng.randrange(starts[k], starts[k + 1])
            data[at] ^= 0x55
        found = list(W.salvage(bytes(data)))
        # In uncompressed headers no digest guards URL, date or id; all other records must be whole.
        assert set(range(30)) - set(hit) <= set(ids(found))
        whole_payloads = {p for _, p, _ in rows}
        assert all(f.payload in whole_payloads for f in found if f.reason is None and "warc-payload-digest" in f.headers)
        for a, b in lost(found):
            assert any(starts[k] <= a and b <= starts[k + 1] or a <= starts[k] < b for k in hit)


def test_truncated_and_foreign_bytes():
    parts = [gzip.compress(r, mtime=0) for _, _, r in make(6)]
    data = b"junk!" + parts[0] + parts[1] + b"\x00" * 50 + parts[2] + parts[3][:40] + parts[4] + parts[5][:-9]
    found = list(W.salvage(data))
    assert ids(found) == [0, 1, 2, 4, 5]  # of the last member only its checksums are cut off
    gaps = lost(found)
    assert gaps[0] == (0, 5) and gaps[-1][1] == len(data) and len(gaps) == 4
    assert list(W.salvage(b"")) == []
    assert lost(list(W.salvage(b"nothing here"))) == [(0, 12)]


def test_several_records_in_a_member():
    data = gzip.compress(b"".join(r for _, _, r in make(4)), mtime=0)
    assert ids(list(W.salvage(data))) == [0, 1, 2, 3]


def test_damage_in_a_member_of_several_records():
    rows = make(40)
    parts = [bytearray(r) for _, _, r in rows]
    parts[7][-10] ^= 0x55  # in the payload, before compression: one record fails its digest
    found = list(W.salvage(gzip.compress(b"".join(parts), mtime=0) + gzip.compress(make(1)[0][2], mtime=0)))
    assert ids(found) == [i for i in range(40) if i != 7] + [0]
    (gap,) = [f for f in found if f.reason]
    begin = sum(len(p) for p in parts[:7])
    assert gap.inner == (begin, len(parts[7])) and gap.offset == 0 and "digest" in gap.reason

    whole = gzip.compress(b"".join(r for _, _, r in rows), mtime=0)
    behind = gzip.compress(make(1)[0][2], mtime=0)
    wrong_sum = bytearray(whole)
    wrong_sum[-6] ^= 0x55
    found = list(W.salvage(bytes(wrong_sum) + behind))
    ((a, b),) = lost(found)
    assert ids(found) == [*range(40), 0] and len(whole) - 8 <= a < b == len(whole)
    cut = list(W.salvage(whole[: len(whole) // 2] + behind))
    assert ids(cut)[:10] == list(range(10)) and ids(cut)[-1] == 0 and len(lost(cut)) >= 1
    middle = bytearray(whole)
    middle[len(whole) // 2] ^= 0x55
    found = list(W.salvage(bytes(middle)))
    assert ids(found)[:10] == list(range(10))
    outer = [f for f in found if f.reason and f.inner is None]
    assert outer and all(f.offset >= len(whole) // 2 - 1 for f in outer)  # what stands before the damage is no gap


def test_a_whole_record_before_a_cut_counts():
    data = b"".join(r for _, _, r in make(10, seed=3))
    for keep in (len(gzip.compress(data, mtime=0)) - 8, len(gzip.compress(data, mtime=0)) - 1):
        found = list(W.salvage(gzip.compress(data, mtime=0)[:keep]))
        assert ids(found) == list(range(10))
        assert [f.reason for f in found if f.reason] == [W.CUT]


def test_bad_version_lines_take_time_in_proportion():
    behind = make(1)[0][2]
    for line in (b"WARC/1.1\r\n", b"WARC/1.0\r\nx\r\n", b"WARC/1.x "):
        data = line * (2_000_000 // len(line)) + behind
        for packed in (data, gzip.compress(data, mtime=0)):
            start = time.process_time()
            found = list(W.salvage(packed))
            assert ids(found) == [0] and len([f for f in found if f.reason]) == 1
            assert time.process_time() - start < 5


PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, tmp_path, **options):
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as first", "1 as n", "'s' as sha1", "'v' as value")
    W.write(df, str(tmp_path / "a"), **options)
    return W.read(spark, str(tmp_path / "a"))


def test_odd_pages(spark, tmp_path):
    long = "é\U0001f600" * 200_000
    rows = [
        (5, "u", "same"), (2, None, "same"), (2, "again", "same"), (9, "u\r\nX: y", None), (8, "u", ""), (7, "u", long),
        (None, "u", "same"), (None, "u", "alone"), (1, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n"),
    ]
    found = round_trip(spark, rows, tmp_path)
    assert W.gaps(found).count() == 0
    out = W.records(found).collect()
    assert len(out) == len(rows)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out), key=str)
    wanted = [
        (5, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (9, "revisit", 8, 0), (8, "response", None, 0),
        (7, "response", None, len(long.encode())), (None, "revisit", 2, 4), (None, "response", None, 5), (1, "response", None, len(rows[-1][2])),
    ]
    assert got == sorted(wanted, key=str)
    texts = {r["payload"].decode() for r in found.collect() if r["payload"] is not None}
    assert texts == {"same", "", long, "alone", rows[-1][2]}


def test_small_payloads_are_all_responses(spark, tmp_path):
    out = W.records(round_trip(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], tmp_path, min_bytes=4))
    assert {r["page_id"]: r["record_type"] for r in out.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], tmp_path).count() == 0


def test_digest_in_sql_is_base32(spark):
    from pyspark.sql import functions as F

    texts = ["", "a", "hello", "é" * 99]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", W.base32_sha1(F.sha1(F.encode("t", "UTF-8"))).alias("d"))
    for r in df.collect():
        assert r["d"] == W.digest_of(r["t"].encode())


def test_query_has_every_page(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    rows = op8_warc(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        p = pages[r["page_id"]]
        again = first[p] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), W.digest_of(p))
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[p]) if again else ("response", None))
