import tempfile
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm.token_files import EliasFano, read_files, write_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    v = sorted(values)
    packed = EliasFano.from_bytes(EliasFano.of(np.array(v, dtype=np.int64)).to_bytes())
    assert packed.all().tolist() == v
    assert [packed.select(i) for i in range(len(v))] == v


def test_elias_fano_is_small():
    v = np.cumsum(np.full(100_000, 900))
    assert len(EliasFano.of(v).to_bytes()) * 8 / len(v) < np.log2(900) + 3
    with pytest.raises(IndexError):
        EliasFano.of(v).select(100_000)


def expected(docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(((r.doc_id, r.text, r.h) for r in docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    start, out = 0, []
    for i, text, _ in rows:
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1, 100, 1 << 20])
def test_files_read_back(spark, odd_docs, block_ids):
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{uuid.uuid4().hex}"
    write_files(odd_docs, path, block_ids=block_ids)
    assert sorted(map(tuple, read_files(spark, path).collect()), key=repr) == sorted(expected(odd_docs), key=repr)


def test_one_id_over_many_shards(spark):
    """Rows of one id are placed by the hash of their text, however they are dealt."""
    docs = spark.createDataFrame([(7 if i % 3 else i, f"text number {i} of a few") for i in range(400)], "doc_id bigint, text string").repartition(13)
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/shards"
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_files(docs, path, block_ids=50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    assert spark.read.parquet(path).select("shard").distinct().count() > 1
    assert sorted(map(tuple, read_files(spark, path).collect())) == sorted(expected(docs))


def test_the_session_stays_as_it_was(spark, odd_docs):
    before = dict(spark.sparkContext.getConf().getAll()), [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/session"
    write_files(odd_docs, path)
    read_files(spark, path).count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")])


def test_no_documents(spark, no_docs):
    path = f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/none"
    write_files(no_docs, path)
    assert read_files(spark, path).count() == 0
