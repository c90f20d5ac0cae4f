import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tallygrain.llm import alignment
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD, prose


@pytest.fixture(scope="module")
def sides():
    return alignment.sides_of(*[alignment.read_file(f) for f in (alignment.BYTE_TOKENIZER, alignment.PIECE_MODEL)])


@pytest.fixture(scope="module")
def libraries():
    """Both libraries and the bytes of an id, taken from their own decoders."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in shown}
    letter |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def encode(text):
        left = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return left, right

    return encode


def plain(rows, encode):
    """Every token pair of a text compared with every other."""
    docs, count = [], Counter()
    for doc, text in rows:
        a, b = encode(text) if text else ([], [])
        want = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            docs.append((doc, [], [], [], ""))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for i, raw in side:
                at += len(raw)
                own.append((i, at))
            ends.append(own)
        by_end = defaultdict(list)
        for i, end in ends[1]:
            by_end[end].append(i)
        links = [(i, j) for i, end in ends[0] for j in by_end[end]]
        count.update(links)
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if before < e <= cut) for side in ends))
            before = cut
        docs.append((doc, ends[0], ends[1], links, ";".join(groups)))
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for doc, a, b, links, groups in docs:
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        n_best = sum(count[p] == most[p[1]] for p in links)
        n_groups = groups.count(";") + 1 if groups else 0
        out.append((doc, len(a), len(b), n_groups, len(links), n_best, sum(count[p] for p in links), sha))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=repr)


def test_query_equals_plain_version(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows]
    got = result(alignment.op12_token_alignment(spark, SF))
    want = plain([(i, t) for i, t in rows if len(t or "") < 4000], libraries)
    # counts are corpus-wide: the long texts' own part comes from the same links
    short = {w[0] for w in want}
    assert [g[:5] + g[7:] for g in got if g[0] in short] == [w[:5] + w[7:] for w in want]
    assert len(got) == len(rows)


@pytest.mark.parametrize("piece_bytes", [1, 300, 1 << 20])
def test_odd_rows_in_blocks_of_any_size(documents, libraries, piece_bytes):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "twice twice"), (3, "twice twice"), (4, "<|endoftext|> <s> </s>")]
    rows += [(20 + i, prose(i, 40)) for i in range(30)] + [(60, "▁ mark"), (61, "trailing  \n"), (62, " leading"), (63, "a\u0000b�🙂é")]
    df = documents(rows, clashing=True)
    assert result(alignment.align_documents(df, piece_bytes=piece_bytes)) == plain(rows, libraries)
    assert alignment.align_documents(df.limit(0)).count() == 0


def test_parts_of_long_texts_encode_like_the_whole(sides):
    text = LONG[:30_000] + "  two\n\nlines 1 2 ... x" + LONG[:20_000]
    parts = alignment.parts_of(text, 1000)
    assert len(parts) > 20 and " ".join(parts) == text
    for side in sides:
        whole = list(side.encode([text])[0])
        assert [i for p in parts for i in side.encode([p])[0]] == whole
    assert alignment.parts_of("x" * 5000, 10) == ["x" * 5000]
    assert alignment.parts_of("", 10) == [""]


def test_a_text_of_other_bytes_has_no_tokens(sides):
    found = alignment.align([None, "", "plain words", "▁ mark"], alignment.Memory(sides))
    assert found.n_a.tolist()[:2] == [0, 0] and found.n_a[2] > 0
    assert found.n_a[3] == found.n_b[3] == 0 and found.groups[3] == b""


def test_words_encode_like_whole_texts(sides):
    rng = random.Random(6)
    alphabet = [" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x85", "\x1c", "A", "b", "the", "'s", "É", "日本", ".", "▁", "<s>", "<|endoftext|>", "7", "🙂", "\u0301"]
    texts = ODD[1:] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for most in (10, 10**6):
        memory = alignment.Memory(sides, most)
        for some in (texts[:700], texts[700:], texts[::-1]):
            for got, want in zip(memory.id_lists(some), alignment.whole_lists(some, sides)):
                assert got.to_pylist() == want.to_pylist()
        assert " ".join(alignment.words_of([texts[5]])[0].to_pylist()) == texts[5]
