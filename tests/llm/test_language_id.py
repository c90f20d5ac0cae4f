import itertools

import numpy as np
from pyspark.sql import functions as F

from tallygrain.llm import language_id as li
from tests.llm.conftest import LONG, ODD

SF = "/root/testdata/sf0.01"


def test_decode_equals_trying_all_paths():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 6, 1, 5]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(scale=3, size=(bounds[-1], 3))
    got = li.decode(scores, bounds, penalty=2.5)
    for a, b in zip(bounds, bounds[1:]):
        part = scores[a:b]

        def total(path):
            return sum(part[i, s] for i, s in enumerate(path)) - 2.5 * sum(x != y for x, y in zip(path, path[1:]))

        if b > a:
            assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=total)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = li.op6_language_id(spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98


def test_mixed_text_falls_into_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.train(docs)
    picked = {l: docs.filter(F.col("lang") == l).orderBy("doc_id").first()["text"].split()[:30] for l in ("de", "fr")}
    text = " ".join(picked["de"] + picked["fr"])
    df = spark.createDataFrame([(1, text), (2, "Привет мир"), (3, "12 34 ..")], "doc_id long, text string")
    got = li.identify(df, model).orderBy("doc_id").collect()
    spans = [(s["first_word"], s["n_words"], s["lang"]) for s in got[0]["spans"]]
    assert [s[2] for s in spans] == ["de", "fr"] and abs(spans[1][0] - 30) <= 2 and sum(s[1] for s in spans) == 60
    assert got[1]["lang_pred"] in model.langs  # no language uses the script: all are candidates
    assert (got[2]["lang_pred"], got[2]["score"]) == ("und", 0.0)


def test_script_narrows_candidates(spark):
    rows = [(i, "да нет это слово и ещё слова", "ru", "a", 1) for i in range(12)] + [
        (i + 20, "yes no this is a word and more words", "en", "a", 1) for i in range(12)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = li.train(df)
    test = spark.createDataFrame([(1, "ещё this слово is word да"), (2, "zzz"), (3, "жжж")], "doc_id long, text string")
    got = li.identify(test, model).orderBy("doc_id").collect()
    assert [s["lang"] for s in got[0]["spans"]] == ["ru", "en", "ru", "en", "ru"]
    assert [g["lang_pred"] for g in got[1:]] == ["en", "ru"]


def test_odd_rows(documents):
    texts = ODD + [LONG]
    df = documents([(i, t) for i, t in enumerate(texts)] + [(None, "the and of", None, None)], clashing=True)
    model = li.train(df)
    got = {r["doc_id"]: r for r in li.identify(df, model).collect()}
    assert len(got) == len(texts) + 1
    letters = [any(c.isalpha() for c in t or "") for t in texts]
    assert [got[i]["lang_pred"] != "und" for i in range(len(texts))] == letters
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = li.keep_known(df, model, 0.4)
    assert kept.columns == df.columns and kept.count() == sum(letters) + 1
    nothing = li.train(df.limit(0))
    assert {r["lang_pred"] for r in li.identify(df, nothing).collect()} == {"und"}
    assert li.identify(df.limit(0), model).count() == 0 and li.identify(df.limit(0), nothing).count() == 0


def test_characters_beyond_the_scripts(spark, documents):
    model = li.train(spark.read.parquet(f"{SF}/documents.parquet"))
    # private use, variation selectors and tags are no letters; the rest of the ideographs are
    texts = ["\U000f0000\U000f0001 \U0010fffd", "\U000e0100", "\U000e0041\U000e007f", "\U00030000", "\U000323af \U000f0000"]
    got = li.identify(documents([(i, t) for i, t in enumerate(texts)]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] == "und" for r in got] == [True, True, True, False, False]
    assert [r["score"] for r in got[:3]] == [0.0] * 3
    bits = li.script_bits()
    assert len(bits) == 0x110000 and all((bits[c] > 0) == chr(c).isalpha() for c in range(0, 0x110000, 97))


def test_more_languages_than_a_byte_counts(documents):
    rng = np.random.default_rng(4)
    scores, bounds = rng.normal(scale=3, size=(400, 300)), np.array([0, 150, 150, 400])
    assert (li.decode(scores, bounds, penalty=0.0) == scores.argmax(axis=1)).all()
    # every language has a letter of its own
    letters = [chr(0x4E00 + i) for i in range(140)]
    df = documents([(i * 7 + k, letters[i] * 3, f"l{i:03}", "a") for i in range(140) for k in range(4)])
    model = li.train(df)
    assert len(model.langs) > 128
    got = li.identify(documents([(i, letters[int(lang[1:])] * 3) for i, lang in enumerate(model.langs)]), model)
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == model.langs
