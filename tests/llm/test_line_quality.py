import itertools
import math
import random
import re
from collections import Counter

import numpy as np

from tallygrain.llm import line_quality as lq
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), symbols, dups, len(inside), failed


def test_base_counts_equal_plain_counts(documents):
    rng = random.Random(3)
    texts = ODD + [LONG] + ["\n".join(rng.choice(["a b c", " a b c", "x # | y", "é 🙂 é", ""]) for _ in range(rng.randrange(40))) for _ in range(60)]
    df = documents([(i, t) for i, t in enumerate(texts)], clashing=True)
    got = lq.judge_lines(df, lq.flat_chain()).orderBy("doc_id").collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    assert [tuple(r[c] for c in names) for r in got] == [base(t) for t in texts]
    # without weights every line is content
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_viterbi_equals_trying_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        chain = lq.Chain(rng.normal(size=2), rng.normal(size=(2, 2)), rng.normal(size=(lq.FEATURES + 1, 2)))
        codes = rng.integers(0, 1 << lq.FEATURES, n).tolist()

        def score(path):
            total = chain.start[path[0]]
            total += sum(lq.scores_of(c, chain)[s] for c, s in zip(codes, path))
            return total + sum(chain.step[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert tuple(lq.decode(codes, chain, {})) == best


def test_fitting_separates_and_uses_neighbours():
    rng = random.Random(2)
    noisy = [([rng.choice([1, 1, 1, 2]) for _ in range(8)], 0) for _ in range(60)]
    noisy += [([rng.choice([2, 2, 2, 1]) for _ in range(8)], 1) for _ in range(60)]
    chain = lq.fit_chain(noisy)
    assert chain.step[0, 0] + chain.step[1, 1] > chain.step[0, 1] + chain.step[1, 0]

    def share_right(codes, y):
        return sum(s == y for s in lq.decode(codes, chain, {})) / len(codes)

    # labelling every line by its own feature alone is right for three lines in four
    assert sum(share_right(c, y) for c, y in noisy) / len(noisy) > 0.85
    assert all(math.isfinite(x) for x in chain.emit.ravel())


def test_one_kind_of_labels_keeps_everything(spark, documents):
    docs = documents([(i, prose(i, 60)) for i in range(5)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in lq.judge_lines(docs, lq.train(docs, labels)).collect()] == [True] * 5
    assert lq.judge_lines(docs.limit(0), lq.train(docs.limit(0), labels)).count() == 0


def test_poor_documents_go_and_good_ones_stay(spark):
    judged = lq.op2_line_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    counts = {(r["quality"], r["kept"]): r["count"] for r in judged.filter("n_words >= 50").join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((0, True), 0) == 0 and counts.get((1, False), 0) <= 0.02 * counts[(1, True)]


def planted(seed, docs, footers, spam):
    """Good texts with footers at random places, and poor ones of a good line or two and much spam."""
    rng = random.Random(seed)
    texts, truth, labels = [], [], []
    for i in range(docs):
        lines = [(prose(1000 * seed + 20 * i + k, rng.randrange(12, 30), 100_000) + ".", 0) for k in range(rng.randrange(4, 9))]
        if i % 4 == 3:
            lines = lines[:1] + [(" ".join(rng.choice(spam) for _ in range(rng.randrange(10, 20))), 1) for _ in range(rng.randrange(4, 8))]
            rng.shuffle(lines)
        else:
            for footer in rng.sample(footers, rng.randrange(3)):
                lines.insert(rng.randrange(len(lines) + 1), (footer, 1))
        texts.append("\n".join(x for x, _ in lines))
        truth.append([y for _, y in lines])
        labels.append(int(i % 4 != 3))
    return texts, truth, labels


FOOTERS = ["All rights reserved.", "Share this page with a friend of yours today.", "Cookies are used here.", "Next page of this list"]
SPAM = ["BUY###", "now$$$", "CLICK!!", "here***", "free&&&", "|||", "WIN!!", "100%%%"]


def test_planted_lines_are_marked_inside_good_texts(spark, documents):
    texts, truth, labels = planted(1, 400, FOOTERS, SPAM)
    fresh, fresh_truth, fresh_labels = planted(2, 200, FOOTERS, SPAM)
    docs = documents(list(enumerate(texts + fresh)))
    known = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    chain = lq.train(docs, known)
    assert {lq.line_hash(x.encode()) for x in FOOTERS} <= chain.common
    got = {r["doc_id"]: r for r in lq.judge_lines(docs, chain, min_words=0).collect()}
    # the texts without a label, too: exactly the planted lines, in good and poor texts
    for i, want in enumerate(truth + fresh_truth):
        assert list(got[i]["lines"]) == want
    assert sum(0 < sum(t) < len(t) for t in fresh_truth) > 100
    assert [got[400 + i]["kept"] or got[400 + i]["base_failed"] for i, y in enumerate(fresh_labels) if y] == [True] * sum(fresh_labels)
    assert not any(got[400 + i]["kept"] for i, y in enumerate(fresh_labels) if not y)


def test_lines_of_copied_documents_are_not_common(documents):
    copied = "\n".join(prose(7000 + k, 15, 100_000) for k in range(6))
    alike = "\n".join(prose(8000 + k, 15, 100_000) for k in range(30))
    rows = [(i, copied) for i in range(300)] + [(1000 + i, prose(i, 20, 100_000) + "\nAll rights reserved.\n" + prose(i + 500, 20, 100_000)) for i in range(40)]
    for i in range(100):  # near copies, a line of each changed
        lines = alike.split("\n")
        lines[i % 30] = prose(9000 + i, 15, 100_000)
        rows.append((2000 + i, "\n".join(lines)))
    assert lq.common_lines(documents(rows, clashing=True)) == {lq.line_hash(b"All rights reserved.")}
    assert lq.common_lines(documents([(1, None), (2, "")])) == lq.common_lines(documents(rows).limit(0)) == frozenset()


def test_marked_lines_at_the_end_of_long_texts(documents, spark):
    texts, truth, labels = planted(3, 300, FOOTERS, SPAM)
    long = "\n".join([prose(50 + k, 20, 100_000) + "." for k in range(500)] + [FOOTERS[0]] + [prose(900, 20, 100_000) + "."])
    docs = documents(list(enumerate(texts + [long])))
    known = spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels + [1])], "doc_id long, quality int, toxic int")
    judged = lq.judge_lines(docs, lq.train(docs, known)).filter("doc_id = 300").first()
    assert list(judged["lines"]) == [0] * 500 + [1, 0] and judged["kept"]


def test_texts_of_the_tables_have_lines_of_both_kinds(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = lq.judge_lines(docs, lq.train(docs, labels)).join(labels, "doc_id", "left").collect()
    several = [r for r in judged if len(r["lines"]) > 1]
    mixed = [r for r in several if len(set(r["lines"])) > 1]
    assert len(mixed) > 0.2 * len(several)
    judged = [r for r in judged if not r["base_failed"] and r["quality"] is not None]
    poor, good = ([r["kept"] for r in judged if r["quality"] == y] for y in (0, 1))
    assert sum(poor) == 0 and sum(good) >= 0.99 * len(good)
