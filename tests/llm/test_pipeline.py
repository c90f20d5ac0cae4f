"""The pipeline against a plain version of every stage."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrain.llm import language_id, mixing, piece_codec
from tests.llm.conftest import SCHEMA
from tests.llm.test_near_dedup import wanted
from tests.llm.test_substring_dedup import WORD
from tests.llm.test_substring_dedup import brute as brute_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def poisson_copies(doc, rate):
    draws = max(1, math.ceil(rate / mixing.SPLIT))
    total = 0
    for i in range(1, draws + 1):
        raw = hashlib.md5(f"{mixing.SEED}|draw|{doc}|{i}".encode()).hexdigest()[:13]
        u, k, cdf = int(raw, 16) / 2**52, 0, math.exp(-rate / draws)
        while cdf <= u:
            k += 1
            cdf += math.exp(k * math.log(rate / draws) - rate / draws - math.lgamma(k + 1))
        total += k
    return total


@pytest.fixture(scope="module")
def some(spark):
    """Documents of the smallest tables, short enough for comparing all pairs."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9001, None, "en", "src1", None), (9002, "12 34 --", "en", "src1", 8), (9003, "", None, None, 0)]
    return df.unionByName(spark.createDataFrame(odd, SCHEMA).select(*df.columns))


def test_stages_equal_plain_versions(spark, some, tmp_path):
    path = str(tmp_path / "in" / "documents.parquet")
    some.write.parquet(path)
    got = corpus_pipeline.run(spark, str(tmp_path / "in")).collect()

    rows = [r.asDict() for r in some.collect()]
    model = language_id.train(some)
    kept = []
    for r in rows:
        letters = language_id.label_words([r["text"] or ""], model)[2][0]
        if letters.sum() and letters.max() / letters.sum() >= corpus_pipeline.MIN_LANGUAGE_SHARE:
            kept.append(r)
    assert 0 < len(rows) - len(kept) < 10
    firsts = {d for d, _, _, first in wanted([(r["doc_id"], r["text"]) for r in kept], 80) if first}
    kept = [r for r in kept if r["doc_id"] in firsts]
    texts = brute_passages([(r["doc_id"], r["text"]) for r in kept])[1]
    for r in kept:
        if texts[r["doc_id"]] != " ".join(WORD.findall(r["text"])):
            r["text"], r["n_chars"] = texts[r["doc_id"]], len(texts[r["doc_id"]])
    kept = [r for r in kept if WORD.search(r["text"])]
    size, total = {}, 0
    for r in kept:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"].encode())
    weights = {s: mixing.WEIGHTS.get(s, mixing.OTHER_WEIGHT) for s in size}
    total = sum(size.values())
    codec = piece_codec.codec_of(piece_codec.read_model()).library
    want = []
    for r in kept:
        rate = total * weights[r["source"]] / sum(weights.values()) / size[r["source"]]
        ids = codec.encode(r["text"])
        row = (*(r[c] for c in COLUMNS), ids, len(ids), hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        want += [row] * poisson_copies(r["doc_id"], rate)
    found = [(*(r[c] for c in COLUMNS), r["ids"], r["n_tokens"], r["decoded_sha256"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_empty_table(spark, some, tmp_path):
    some.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark, some):
    docs = some.limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns[: len(docs.columns)] == docs.columns


def test_columns_of_any_name_and_repeated_rows(spark, some, tmp_path):
    """Clashing names keep their values and types; repeated rows come down to one before they are mixed."""
    names = [*mixing.OWN_COLUMNS, *corpus_pipeline.CODED, "_id", "hi", "lo", "kept", "key", "_A", "spans"]
    docs = some.filter("doc_id < 60")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = docs.unionByName(docs.filter("doc_id < 20")).unionByName(docs.filter("doc_id < 5"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes
    # the same rows without the other columns
    docs.select(*COLUMNS).write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    plain = corpus_pipeline.run(spark, str(tmp_path / "plain"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    coded = ["ids", "n_tokens", "decoded_sha256"]
    assert sorted(map(tuple, got.select(*COLUMNS, *coded).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    for i, name in enumerate(names):
        column = f"{name}_" if name in corpus_pipeline.CODED else name
        assert got.filter(F.col(column) != F.concat(F.lit(f"{i}-"), F.col("doc_id").cast("string"))).isEmpty()
    one = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert one.filter("text is not null and doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
