import random
import re

import numpy as np
import pytest

from tallygrain.llm import near_dedup as nd
from tests.llm.conftest import LONG, ODD, prose

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, percent=85):
    """(n_shingles, component) of each row by comparing all pairs; every row its own document."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def result(df, **kw):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(df, **kw).collect())


def wanted(rows, percent=85):
    return sorted((d, n, c, d == c) for (d, _), (n, c) in zip(rows, brute(rows, percent)))


def edited(text, seed, changes):
    words, rng = text.split(), random.Random(seed)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def families():
    """Texts near the threshold, chains of links, copies in other case, unrelated texts."""
    rows = []
    for f in range(6):
        base = prose(f, 260, 3000)
        rows += [(base, 0)] + [(edited(base, 100 * f + i, 1 + (i + f) % 9), 0) for i in range(14)]
        chain = base
        for i in range(8):
            chain = edited(chain, 7000 + 10 * f + i, 4)
            rows.append((chain, 0))
        rows += [(base.upper(), 0), (base.replace(" ", "\n\t "), 0)]
    rows += [(prose(500 + i, 80), 0) for i in range(60)]
    random.Random(9).shuffle(rows)
    return [(i + 1, t) for i, (t, _) in enumerate(rows)]


def test_given_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = [shingle_set(t) for _, t in rows]
    holders, near = {}, set()
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        near |= {(j, i) for j, n in shared.items() if 100 * n >= 85 * (len(s) + len(sets[j]) - n)}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j, i in near:
        root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    want = sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    assert result(df) == want


def test_families_equal_brute_force(documents, families):
    assert result(documents(families, clashing=True)) == wanted(families)


def test_blocks_find_the_same_links(documents, families, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ROWS", 3)
    assert result(documents(families), small=2) == wanted(families)


def test_overlaps_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 4000, 3000, 700)]
    got = nd.overlaps(sets[:4], sets[3:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[3:]] for a in sets[:4]]


def test_signature_estimates_similarity():
    a = nd.shingles(prose(1, 900, 9000).encode())
    b = nd.shingles(edited(prose(1, 900, 9000), 1, 30).encode())
    both = len(np.intersect1d(a, b))
    similar = both / (len(a) + len(b) - both)
    agree = (nd.signature(a, 2000) == nd.signature(b, 2000)).mean()
    assert abs(agree - similar) < 0.05


def test_odd_rows(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(20, LONG), (21, LONG.upper()), (22, "a b c d"), (23, "A B C D"), (24, "a b c d e")]
    assert result(documents(rows, clashing=True)) == wanted(rows)
    repeated = [(5, "p q r"), (5, "p q r"), (4, "p q r"), (6, "p  q r")]
    assert result(documents(repeated)) == wanted(repeated)
    alone = nd.near_duplicates(documents([(None, "p q r"), (None, None), (1, "p q r")])).collect()
    assert sorted(((r["component_id"], r["kept"]) for r in alone), key=repr) == [(1, True), (None, True), (None, True)]
    assert nd.near_duplicates(documents(rows).limit(0)).count() == 0


def test_dropping_keeps_columns_and_one_of_each_group(documents, families):
    df = documents(families + [(None, "without id")], clashing=True)
    left = nd.drop_near_duplicates(df)
    assert left.columns == df.columns
    want = {d for d, _, _, kept in wanted(families) if kept} | {None}
    assert {r["doc_id"] for r in left.collect()} == want and left.count() == len(want)


def test_dropping_takes_a_limit(documents):
    # 200 shingles; a changed word breaks five: four words apart leave 180 of 220 (0.82), five 175 of 225 (0.78)
    rows = []
    for t in range(12):
        words = [f"t{t}w{i}" for i in range(204)]
        changed = [f"x{i}" if i % 40 == 20 and i < 40 * (4 if t < 8 else 5) else w for i, w in enumerate(words)]
        rows += [(2 * t, " ".join(words)), (2 * t + 1, " ".join(changed))]
    df = documents(rows)
    kept = {r["doc_id"] for r in nd.drop_near_duplicates(df, percent=80).collect()}
    assert kept == {2 * t for t in range(12)} | {2 * t + 1 for t in range(8, 12)}
    assert nd.drop_near_duplicates(df).count() == 24


def test_removal_is_by_id_and_text(documents):
    base = [prose(i, 60, 100_000) for i in range(6)]
    rows = [(1, base[0]), (2, edited(base[0], 1, 1)), (2, base[1]), (3, base[2]), (3, base[2]), (3, base[2]), (4, base[3]), (4, None)]
    rows += [(5, None), (5, ""), (5, ""), (None, base[4]), (None, base[4]), (6, edited(base[3], 2, 1)), (7, base[5])]
    for clashing in (False, True):
        kept = nd.drop_near_duplicates(documents(rows, clashing=clashing), percent=80)
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
        # the near copy under id 2 goes, the other text stays; repeated rows come down to one; rows without an id stay
        want = [(1, base[0]), (2, base[1]), (3, base[2]), (4, base[3]), (4, None), (5, None), (5, "")]
        want += [(None, base[4]), (None, base[4]), (7, base[5])]
        assert got == sorted(want, key=repr)
    assert kept.columns == documents(rows, clashing=True).columns


def test_removal_of_texts_under_one_hot_id(documents):
    texts = [prose(i, 40, 100_000) for i in range(200)]
    rows = [(9, texts[i % 200]) for i in range(600)] + [(i + 10, texts[i]) for i in range(100)] + [(1, texts[5])]
    got = nd.drop_near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(9, t) for i, t in enumerate(texts) if i != 5] + [(1, texts[5])])
