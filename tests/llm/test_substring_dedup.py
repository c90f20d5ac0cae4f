import hashlib
import random
import re

import numpy as np
import pytest

from tallygrain.llm import common
from tallygrain.llm import substring_dedup as sd
from tests.llm.conftest import LONG, ODD, prose

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """(doc_id, n_words, n_removed, sha) and kept text of rows with different ids."""
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, d), d)
    out, texts = [], {}
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        texts[d] = kept
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out), texts


def result(df):
    return sorted(tuple(r) for r in sd.repeated_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


@pytest.fixture(scope="module")
def passages():
    """Texts of unique words with shared passages of 45 to 130 words at all offsets, copies, repeats inside a text."""
    rng = random.Random(4)
    shared = [prose(9000 + i, 45 + 7 * i, 5000) for i in range(13)]
    rows = []
    for d in range(120):
        parts = [prose(d * 10 + k, rng.randrange(0, 90), 10**7) for k in range(3)]
        if d % 2:
            parts.insert(rng.randrange(4), rng.choice(shared))
        if d % 5 == 0:
            parts += [rng.choice(shared)] * 2
        rows.append((d * 3 - 50, "\n".join(parts)))
    rows += [(1000 + i, rows[i][1].replace(" ", "  \t")) for i in range(0, 40, 4)]
    rows += [(2000, "same " * 400), (2001, "same " * 60), (-99, "same " * 49), (2002, "same " * 50)]
    rng.shuffle(rows)
    return rows


def test_cover_aligns_any_two_places():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    for n in (49, 50, 51, 80, 81, 200):
        places = sd.anchor_places(n)
        assert n < 50 or all(any(i <= p and p + sd.ANCHOR <= i + 50 for p in places) for i in range(n - 49))


def test_given_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])[0]


def test_passages_equal_brute_force(documents, passages):
    want, _ = brute(passages)
    assert sum(w[2] for w in want) > 2000
    assert result(documents(passages, clashing=True)) == want


def test_shuffled_ids_give_the_same(documents, passages, monkeypatch):
    monkeypatch.setattr(common.among, "__defaults__", (True, 0))
    assert result(documents(passages)) == brute(passages)[0]


def test_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(30, LONG), (31, "lead " + LONG), (32, LONG[: len(LONG) // 2])]
    assert result(documents(rows, clashing=True)) == brute(rows)[0]
    text = prose(1, 70)
    twice = result(documents([(5, text), (5, text), (4, text), (None, text), (None, None)][:3]))
    empty = hashlib.sha256(b"").hexdigest()
    assert twice == [(4, 70, 0, hashlib.sha256(text.encode()).hexdigest()), (5, 70, 70, empty), (5, 70, 70, empty)]
    none = sd.repeated_words(documents([(None, text), (3, text), (None, None)])).collect()
    assert sorted(r["n_removed"] for r in none) == [0, 0, 0]
    assert sd.repeated_words(documents(rows).limit(0)).count() == 0


def test_texts_are_cut_and_columns_stay(documents, passages):
    df = documents(passages + [(None, "no id")], clashing=True)
    left = sd.remove_repeats(df)
    assert left.columns == df.columns
    given, (_, texts) = dict(passages), brute(passages)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert got.pop(None) == ("no id", 5)
    changed = {d for d, t in texts.items() if t != " ".join(WORD.findall(given[d]))}
    assert set(got) == {d for d in texts if d not in changed or texts[d]}
    assert all(t == (texts[d] if d in changed else given[d]) and n == len(t) for d, (t, n) in got.items())


def test_hash_spans():
    words = sd.Words(b" a  bb\nccc a bb ")
    assert len(words) == 5 and words.joined == b"a bb ccc a bb"
    two = words.hashes(np.array([0, 1, 3]), 2)
    assert two[0] == two[2] != two[1]
