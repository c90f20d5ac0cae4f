import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallygrain.llm import variants
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD, prose


def edits_of(word, letters):
    """All words one inserted, deleted or replaced letter away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters}
    out |= {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def plain(rows, every=31, least=7):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    letters = sorted({c for w in words for c in w})
    form, near = {}, {}
    for w, n in words.items():
        around = [x for x in edits_of(w, letters) if x in words]
        near[w] = len(around)
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items())


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows)
    assert len(want) > 1000 and any(w[4] for w in want)
    assert result(variants.op13_spelling_variants(spark, SF)) == want


def chained(seed, n):
    """Words in families: a frequent one, variants of it, and variants of those."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 11)))
        for times in (300, 25, 2):
            out += [word] * times
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + "x" + word[at:], word[:at] + "y" + word[at + 1 :], word[:at] + word[at + 1 :] + "z"])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("leaf,cell,group", [(4096, 16384, 65536), (20, 30, 25), (4, 4, 3)])
def test_trees_cells_and_groups_of_any_size(spark, documents, monkeypatch, leaf, cell, group):
    monkeypatch.setattr(variants, "LEAF_WORDS", leaf)
    monkeypatch.setattr(variants, "LEAST_SAMPLES", 2)
    monkeypatch.setattr(variants, "CELL_WORDS", cell)
    monkeypatch.setattr(variants, "GROUP_QUERIES", group)
    monkeypatch.setattr(variants, "NODE_WORDS", 3)
    words = chained(3, 60)
    # words with the same letters in other orders: no tree can part them
    rng = random.Random(8)
    for _ in range(60):
        letters = list("abcdefgh")
        rng.shuffle(letters)
        words += ["".join(letters)] * 2 + ["".join(letters[:5]) + "z" + "".join(letters[6:])] * 30
    rows = [(i, " ".join(words[at : at + 400])) for i, at in enumerate(range(0, len(words), 400))]
    want = plain(rows)
    got = result(variants.spelling_variants(documents(rows), delete_every=31))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)


def test_search_equals_all_pairs():
    rng = np.random.default_rng(2)
    words = ["".join(x) for x in rng.choice(list("abcà"), (300, 7))]
    longer = ["".join(x) for x in rng.choice(list("abcà"), (300, 8))]
    for targets, queries in ((words, words), (longer, words)):
        i, j = variants.search(variants.codes(targets), variants.codes(queries))
        want = {(a, b) for a, x in enumerate(queries) for b, y in enumerate(targets) if y in edits_of(x, "abcà")}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "Variants variants"), (None, "variant variant"), (5, None), (9, LONG)]
    rows += [(6, "twice repeated rows")] * 3 + [(7, "ÉtÉr×÷e ÉtÉr×÷e " + "y" * 5000 + " " + "y" * 5000)]
    df = documents(rows, clashing=True)
    assert result(variants.spelling_variants(df, delete_every=31)) == plain(rows)
    assert result(variants.spelling_variants(df)) == plain(rows, None)
    assert variants.spelling_variants(df.limit(0)).count() == 0


def test_hot_text_counts_every_copy(documents):
    rows = [(i, "Wonderful wonderfull" if i % 3 == 0 else prose(i, 6)) for i in range(900)]
    assert result(variants.spelling_variants(documents(rows), delete_every=31)) == plain(rows)
