import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallygrain.llm import packed_ids
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD


@pytest.fixture(scope="module")
def encoder():
    return packed_ids.encoder_of(packed_ids.read_tokenizer())


def plain(encoder, texts):
    return [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_equal_library(encoder):
    rng = random.Random(4)
    alphabet = [" ", "\n", "\t", "A", "b", "the", "'s", "É", "ç", ".", ",", "×", "<|", "|>", "́", "İ", "7", "🙂", "\x85"]
    texts = ODD + [LONG] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(70))) for _ in range(2000)]
    texts += ["<|endoftext|>", "a<|endoftext|>. B", "it's. We'LL,", "H̱a Á. ×. a×. ... .. , ."]
    ids, bounds = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain(encoder, texts)


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 31, 32])
def test_pack_and_unpack_any_range(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 777, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-777 * bits // 8)
    for a, b in ((0, 777), (0, 0), (5, 6), (123, 700), (776, 777), (777, 777)):
        assert packed_ids.unpack(data, bits, a, b).tolist() == ids[a:b].tolist()


def test_block_gives_single_documents():
    ids = np.arange(100, dtype=np.uint32)
    block = packed_ids.pack_block(ids, np.array([0, 10, 10, 100]), 11)
    assert [packed_ids.document_ids(block, i).tolist() for i in range(3)] == [list(range(10)), [], list(range(10, 100))]
    with pytest.raises(ValueError):
        packed_ids.read_head(b"x" * 40)


def check(got, rows, encoder):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for row, (doc, _), ids in zip(got, rows, plain(encoder, [r[1] for r in rows])):
        ids = [*ids, packed_ids.END_ID]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc, start, len(ids), crc)
        start += len(ids)


def test_query_reads_back_what_was_written(spark, encoder):
    got = packed_ids.op9_packed_ids(spark, SF).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(got, rows, encoder)


def test_odd_rows_and_small_blocks(spark, documents, encoder, tmp_path):
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "twice"), (7, "twice"), (7, "other"), (-5, LONG)]
    df = documents([r if r[1] is not None else (r[0], None) for r in rows], clashing=True)
    packed_ids.write_packed(df, str(tmp_path / "a"), block_ids=5)
    blocks = packed_ids.read_packed(spark, str(tmp_path / "a"))
    assert all(r["n_ids"] >= 5 or r["place"] >= 0 for r in blocks.collect())
    check(packed_ids.document_digests(blocks).orderBy("start", "n_tokens").collect(), rows, encoder)
    packed_ids.write_packed(df.limit(0), str(tmp_path / "b"))
    assert packed_ids.document_digests(packed_ids.read_packed(spark, str(tmp_path / "b"))).count() == 0
