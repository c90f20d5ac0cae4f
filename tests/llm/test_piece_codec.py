import hashlib
import random

import pyarrow as pa
import pytest

from tallygrain.llm import piece_codec
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD


@pytest.fixture(scope="module")
def codec():
    return piece_codec.codec_of(piece_codec.read_model())


def same(codec, texts):
    ids = codec.encode(pa.array(texts, pa.string()))
    assert ids.to_pylist() == codec.library.encode([t or "" for t in texts])
    assert codec.decode(ids).to_pylist() == codec.library.decode(ids.to_pylist())


def test_equals_library_on_random_texts(codec):
    rng = random.Random(1)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "the", "ing", "é", "▁", "🙂", "日", "Z", ".", "7", "\x00"]
    same(codec, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(1500)])


def test_equals_library_on_odd_texts(codec):
    spaces = [" " * n + "x" + " " * (40 - n) for n in range(41)]
    same(codec, ODD + spaces + [LONG, "ab" * 5000, "🙂" * 200, "▁" * 100, "a" * 24, "a" * 25])
    nothing = codec.encode(pa.array([], pa.string()))
    assert nothing.to_pylist() == codec.decode(nothing).to_pylist() == []
    same(codec, [None, ""])


def test_short_and_long_ways_agree(codec):
    units = ["▁" + "".join(random.Random(i).choices("etaoinsh", k=20)) for i in range(200)]
    symbols = [codec.of_char[[ord(c) for c in u]] for u in units]
    for unit, s in zip(units, symbols):
        out, counts = codec.merge_short(s[None, :])
        assert out[0, : counts[0]].tolist() == codec.merge_long(s.tolist())


def test_difference_from_library_is_found(codec):
    texts = pa.array(["hello world"])
    with pytest.raises(RuntimeError):
        codec.check(texts, pa.array([[1, 2]], pa.list_(pa.int32())), 1)


def test_query_digests(spark, codec):
    got = piece_codec.op5_sentencepiece(spark, SF).orderBy("doc_id").collect()
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert len(got) == len(texts)
    for row, text in zip(got, texts):
        ids = codec.library.encode(text or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()


def test_rows_and_columns_stay(documents):
    df = documents([(i, t) for i, t in enumerate(ODD)] + [(None, "a", None, None), (1, "a"), (1, "a")], clashing=True)
    coded = piece_codec.encode_decode(df, check_every=1)
    assert sorted(coded.columns) == sorted([*df.columns, "decoded"])  # the given ids column is replaced
    assert coded.count() == len(ODD) + 3
    empty = piece_codec.digests(piece_codec.encode_decode(documents([(1, None)])))
    assert empty.first()["n_tokens"] == 0 and empty.first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert piece_codec.encode_decode(df.limit(0)).count() == 0
