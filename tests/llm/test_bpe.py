import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessera.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


def expected(text):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(32768, 1024), (300, 40), (64, 10)])
def test_equals_the_library_at_any_chunk_size(spark, small, odd_docs, chunk, overlap):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    got = bpe.digests(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, chunk, overlap), RANKS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.doc_id, *expected(r.text))) for r in rows)


def test_whitespace_and_contractions_at_window_ends(spark):
    texts = ["a" * 60 + "  \n\n  x'll y're" * 20, "'" * 200, " " * 300 + "z", "ab'" * 100 + "re", "日本語 テキスト " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (20, 33, 64):
        got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, chunk, 10), RANKS)).collect()}
        assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_empty_table(spark, no_docs):
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, RANKS, P.PATTERN), RANKS)).count() == 0


def test_decoded_by_the_worker_that_encoded(spark, small, odd_docs):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd_docs, allowMissingColumns=True)
    for chunk, overlap in ((32768, 1024), (300, 40)):
        one = bpe.encode(docs, RANKS, P.PATTERN, chunk, overlap, decoded=True)
        two = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN, chunk, overlap), RANKS)
        assert sorted(map(str, bpe.digests(one).collect())) == sorted(map(str, bpe.digests(two).collect()))
        passes = [x._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for x in (one, two)]
        assert passes[0] == passes[1] - 1


def test_idle_workers_hold_no_pieces(spark, small):
    import gc

    import pyarrow as pa

    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(8)
    bpe.encode(docs, RANKS, P.PATTERN).write.format("noop").mode("overwrite").save()

    def held(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(len(x) for x in gc.get_objects() if type(x).__name__ == "_Pieces")]})

    assert {r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()} == {0}
