import base64
import glob
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import contamination, warc
from tessera.llm.common import new_path


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("most", [1_000_000, 5])
def test_contamination_against_brute_force(spark, small, odd_docs, most):
    items = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(901, "one two"), (902, None), (None, "one two three four five six")], "item_id long, text string"))
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True)
    docs = docs.unionByName(spark.createDataFrame([(9000, items.first().text.upper() + " and more"), (9000, items.first().text)], "doc_id long, text string"), allowMissingColumns=True)
    got = sorted(str(tuple(r)) for r in contamination.contaminated(docs, items, most_broadcast=most).collect())
    best = {}
    for i in items.collect():
        y = shingles(i.text)
        for d in docs.select("doc_id", "text").collect():
            n = len(y & shingles(d.text))
            if y and 100 * n >= 80 * len(y):
                best[d.doc_id, i.item_id] = max(best.get((d.doc_id, i.item_id), (0, 0)), (len(y), n))
    assert got == sorted(str((*k, *v)) for k, v in best.items())


def test_contamination_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contaminated(odd_docs, none).count() == 0
    assert contamination.contaminated(no_docs, none).count() == 0


@pytest.mark.parametrize("roll", [16_000_000, 3_000])
def test_archives_round_trip(spark, small, roll):
    rows = [(901, None, None), (902, "u r\n", ""), (903, "http://é/", "<p>é</p>"), (904, "b", "<p>é</p>"), (None, "b", "<p>q</p>"), (905, "c", "x" * 300_000), (906, "d", "y"), (906, "d", "y")]
    pages = spark.read.parquet(f"{small}/pages.parquet").unionByName(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for name in ("digest", "payload", "link", "block", "first", "revisit"):  # columns named like inner ones
        pages = pages.withColumn(name, F.lit("x"))
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    rows = pages.collect()
    top = {}
    for r in rows:
        top[digest(r.html)] = max(top.get(digest(r.html), -1), -1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        d = digest(r.html)
        first = r.page_id == top[d] or top[d] == -1
        want.append(str((r.page_id, len((r.html or "").encode()), d, "response" if first else "revisit", None if first else top[d])))
    files = []
    for _ in range(2):
        path = new_path(spark, "warc")
        listed = warc.write(pages.repartition(3), path, roll_bytes=roll)
        got = warc.read(spark, path)
        assert sorted(str(tuple(r)) for r in got.drop("url", "payload").collect()) == sorted(want)
        names = sorted(glob.glob(path.removeprefix("file://") + "/*.warc.gz"))
        assert len(names) == len(listed) and sum(x["records"] for x in listed) == len(rows)
        files.append([hashlib.sha256(open(n, "rb").read()).hexdigest() for n in names])
        assert gzip.open(names[0]).read().startswith(b"WARC/1.1\r\n")
    assert files[0] == files[1]
    payloads = {r.page_id: r.payload for r in got.where("record_type = 'response'").collect()}
    assert bytes(payloads[905]) == b"x" * 300_000


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyy"), (4, "d", "yyyy")], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write(pages, path, least_bytes=3)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, path).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_many_copies_of_one_page_and_long_files(spark):
    """More than a thousandth of all rows share a payload; blocks hold several files."""
    rows = [(i, f"http://h/{i}", "same" if i % 3 else f"page {i} " * 50) for i in range(900)] + [(None, "http://n", "same")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "warc")
    listed = warc.write(pages, path, roll_bytes=20_000)
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) == sum(x["records"] for x in listed) and len(listed) > 10
    assert all(x["bytes"] <= 20_000 + 100 for x in listed)
    assert all(r.refers_to == 899 for r in got if r.record_type == "revisit")
    assert sum(r.record_type == "response" for r in got) == 301


def test_long_payload_has_a_file_of_its_own(spark):
    import random

    noise = random.Random(1).randbytes(150_000).hex()
    path = new_path(spark, "warc")
    listed = warc.write(spark.createDataFrame([(1, "a", "x"), (2, "b", noise), (3, "c", "y")], "page_id long, url string, html string"), path, roll_bytes=20_000)
    assert [x["records"] for x in listed] == [1, 1, 1]
    assert {r.page_id: r.payload_bytes for r in warc.read(spark, path).collect()} == {1: 1, 2: 300_000, 3: 1}


def test_empty_archive_and_damage(spark):
    path = new_path(spark, "warc")
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path) == []
    assert warc.read(spark, path).count() == 0
    good = warc._member(warc.record(1, "u", b"abc", warc.digest32(b"abc"), "response", None, "", "2024-01-01T00:00:00Z"))
    assert len(list(warc.parse(good))) == 1
    with pytest.raises(ValueError):
        list(warc.parse(good[:-9]))
