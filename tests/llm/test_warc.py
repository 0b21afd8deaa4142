import gzip
import hashlib
import io
import random

from sparkveil.llm import warc

PAGES = "page_id long, url string, html string, digest string, refers_to string"


def test_loser_tree():
    rng = random.Random(5)
    for n in range(12):
        runs = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 7, 30]))) for _ in range(n)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_records_round_trip():
    bodies = [b"", b"x", "ä\r\n\r\nWARC/1.1\r\n".encode(), b"\x00" * 3_000_000]
    data = b"".join(warc.member(warc.record(f"k{i}", "http://a/\r\nb", i, 1_800_000_000 + i, b, 7 if i == 1 else None)) for i, b in enumerate(bodies))
    rows = list(warc.index_rows(io.BytesIO(data), "run"))
    assert [r[2] for r in rows] == [0, 1, 2, 3] and [r[5] for r in rows] == ["response", "revisit", "response", "response"]
    assert [r[3] for r in rows] == [len(b) for b in bodies] and [r[4] for r in rows] == [hashlib.sha1(b).hexdigest() for b in bodies]
    assert rows[1][6] == 7 and rows[2][1] == 1_800_000_002
    plain = gzip.decompress(data)  # members are an ordinary gzip file
    for fields, block in warc.records(io.BytesIO(gzip.compress(plain))):
        assert int(fields["Content-Length"]) == len(block)
    broken = data[:-40]
    try:
        list(warc.index_rows(io.BytesIO(broken), "run"))
    except (EOFError, ValueError):
        pass
    else:
        raise AssertionError("a cut archive must not pass")


def want(rows):
    out = []
    for p, u, h in rows:
        data = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        again = len(data) >= 1000 and bool(same) and p != max(same)
        out.append((p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


def test_pages(spark, tmp_path):
    big = "<p>" + "ö" * 600
    rows = [(k, f"http://h{k % 3}.example.com/p{k % 5}#x", big if k % 3 == 0 else f"page {k}") for k in range(200)]
    rows += [(10**12, "big", "large id"), (2**63 - 1, "most", "w" * 1500), (-(10**11), "less", "w" * 1500), (-(2**63), "least", None), (251_635_075_200, "y", "w" * 1500)]
    rows += [(300, None, None), (301, "", "x" * 999), (302, "http://a", "x" * 999), (303, "a", "y" * 1000), (304, "b", "y" * 1000), (304, "b", "y" * 1000), (None, "c", "y" * 1000), (None, "c", "z" * 2000), (None, "d", "z" * 2000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    folder = f"file://{tmp_path}/archives"
    other = warc.write(df, f"{folder}2", broadcast_rows=3)
    assert sorted(map(str, (r[:7] for r in warc.read(other, f"{folder}2").collect()))) == sorted(map(str, (r[:7] for r in warc.read(warc.write(df, f"{folder}3"), f"{folder}3").collect())))
    files = warc.write(df, folder)
    assert sum(r["records"] for r in files.collect()) == len(rows)
    merged = warc.merge(warc.read(files, folder), range_rows=20).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in merged), key=str) == want(rows)
    ordered = sorted(merged, key=lambda r: r["history_order"])
    assert [r["history_order"] for r in ordered] == list(range(len(rows)))
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in ordered]
    assert keys == sorted(keys) and keys[-1][0].startswith("com,example,h")
    empty = warc.write(df.limit(0), folder)
    assert warc.merge(warc.read(empty, folder)).count() == 0
