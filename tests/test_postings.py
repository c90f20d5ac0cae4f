"""The inverted index against a scan: same rows, and only the parts of the terms are opened."""

import random

import pytest
from pyspark.sql import functions as F

from tallygrain.operators import postings, predicates, splitters

rng = random.Random(7)
WORDS = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("", "n", "ne", "x9", "é")]


def texts(n=3000):
    """A third of the texts hold ``hot``; some are null, empty or of odd characters."""
    out = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(1, 9))] + (["Hot"] if i % 3 == 0 else [])
        rng.shuffle(words)
        out.append((i * 7 - 500, rng.choice([" ", ", ", " - ", "\n"]).join(words)))
    return out + [(-9000, None), (-9001, ""), (-9002, "...,"), (None, "hot bane"), (30_000, "BANE bane Bane"), (30_001, "日本 éa")]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def index(spark, rows):
    # small chunks and parts, so that there are many
    before = postings.CHUNK, postings.ROWS_A_PART
    postings.ROWS_A_PART = 16
    made = postings.build(spark.createDataFrame(rows, "id long, text string").repartition(5), "id", postings.letter_tokens("text"), "t", chunk=50)
    postings.CHUNK, postings.ROWS_A_PART = before
    return made


def tokens(text):
    out, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        else:
            out.add(word)
            word = ""
    return out - {""}


def plain(rows, terms, mode):
    def has(own, t):
        return any(w.startswith(t[:-1]) if t.endswith("*") else w == t for w in own)

    return sorted(i for i, text in rows if i is not None and (all if mode == "&" else any)(has(tokens(text), t) for t in terms))


SEARCHES = {
    "one": (["hot"], "&"),
    "prefix": (["ba*"], "&"),
    "both": (["hot", "bane"], "&"),
    "any": (["gon", "hux9"], "|"),
    "mixed": (["hot", "c*", "dé"], "|"),
    "all three": (["a*", "b*", "hot"], "&"),
    "repeated": (["hot", "hot"], "&"),
    "absent": (["zzz"], "&"),
    "half absent": (["hot", "zzz"], "&"),
    "letters": (["日本"], "&"),
    "empty": ([""], "&"),
    "accent": (["é*"], "&"),
}


def test_a_batch_of_searches_finds_what_a_scan_finds(index, rows):
    got = {}
    for r in index.search(SEARCHES).collect():
        got.setdefault(r["search"], []).append(r["id"])
    for name, (terms, mode) in SEARCHES.items():
        want = [] if name == "empty" else plain(rows, terms, mode)
        assert sorted(got.get(name, [])) == want, name
    assert len(got["one"]) >= 1000 and len(got["both"]) > 5


def test_only_the_parts_of_the_terms_are_read(index):
    assert len(index.parts) > 12

    def opened(*terms):
        files = index.search({"s": (list(terms), "&")}).inputFiles()
        return {f.split("part=")[1].split("/")[0] for f in files}

    every = {str(p) for p, _, _ in index.parts}
    for term in ("bane", "gux9", "da*"):
        parts = opened(term)
        assert 0 < len(parts) <= 4 and parts < every
        for p, low, high in index.parts:
            held = low[: len(term) - 1] <= term[:-1] <= high if term.endswith("*") else low <= term <= high
            assert (str(p) in parts) == held
    assert len(opened("zzzz")) <= 1 and opened("龠") == set()
    assert opened("bane", "gux9") == opened("bane") | opened("gux9")


def test_hot_tokens_are_rows_of_bounded_size(spark, index):
    stored = spark.read.schema(postings.FIELDS).parquet(index.path)
    sizes = stored.groupBy("token").agg(F.max(F.size("gaps")).alias("most"), F.count("*").alias("chunks")).collect()
    assert max(r["most"] for r in sizes) <= 50 and {r["token"]: r["chunks"] for r in sizes}["hot"] >= 20
    # sorted, and told by their differences
    assert stored.filter(F.size(F.filter("gaps", lambda g: g < 0)) > 0).isEmpty()
    assert stored.filter(F.array_sort("gaps") != F.col("gaps")).isEmpty() and stored.filter("gaps[0] != 0").isEmpty()


def test_parts_are_even(index, spark):
    counts = [r["count"] for r in spark.read.schema(postings.FIELDS).parquet(index.path).groupBy("part").count().collect()]
    assert max(counts) <= 2 * sum(counts) / len(counts)


def test_index_of_nothing(spark, table):
    made = postings.build(table([(1, None), (2, "")], "id long, text string"), "id", postings.letter_tokens("text"), "none")
    assert made.parts == [] and made.search({"s": (["a*"], "|")}).count() == 0


def test_only_rows_and_chunks_are_placed_not_their_tokens(spark, table, monkeypatch):
    # placing a row among cut points is the dearest step; 120 texts of 40 words are 4,800 pairs
    placed, plain_block = [], splitters.with_block

    def spy(df, *args, **more):
        placed.append(df.count())
        return plain_block(df, *args, **more)

    monkeypatch.setattr(splitters, "with_block", spy)
    made = postings.build(table([(i, " ".join(WORDS[:40])) for i in range(120)], "id long, text string"), "id", postings.letter_tokens("text"), "p")
    chunks = spark.read.schema(postings.FIELDS).parquet(made.path).count()
    assert sum(placed) <= 120 + chunks and made.search({"s": (["ba*"], "&")}).count() == 120


def test_ids_of_several_blocks(spark, table, monkeypatch):
    # far apart, below 0, and in rows that come twice under other texts
    monkeypatch.setattr(postings, "IDS_A_BLOCK", 32)
    ids = [i * 10**12 for i in range(-400, 400)] + list(range(1, 200))
    given = [(i, "hot bane") for i in ids] + [(i, "Bane, hot; gux") for i in ids[::3]] + [(None, "hot")]
    made = postings.build(table(given, "id long, text string"), "id", postings.letter_tokens("text"), "b", chunk=20)
    found = made.search({"hot": (["hot"], "&"), "gux": (["gu*"], "&")}).collect()
    assert sorted(r["id"] for r in found if r["search"] == "hot") == sorted(ids)
    assert sorted(r["id"] for r in found if r["search"] == "gux") == sorted(ids[::3])
    # each id stands once, in chunks that follow one another
    spans = F.col("first").alias("low"), (F.col("first") + F.element_at("gaps", -1)).alias("high"), F.size("gaps").alias("n")
    stored = spark.read.schema(postings.FIELDS).parquet(made.path).filter("token = 'hot'").select(*spans).orderBy("low").collect()
    assert len(stored) > 50 and sum(r["n"] for r in stored) == len(ids) and max(r["n"] for r in stored) <= 20
    assert all(a["high"] < b["low"] for a, b in zip(stored, stored[1:]))


@pytest.mark.parametrize("key,term", [("prefix_text_search", "aile*"), ("movie_by_name", "eauo*")])
def test_queries_find_what_the_scan_finds(spark, key, term):
    from __spark_entry__ import queries
    from tallygrain.plans.documents import _newest
    from tallygrain.shapes import shape

    sf = "/root/testdata/sf0.01"
    got = [r["movie_id"] for r in queries()[key](spark, sf).collect()]
    scan = predicates.text_prefix_search(shape(spark, sf, "movies"), "title", term, _newest(), 16)
    assert got == [r["movie_id"] for r in scan.collect()]


@pytest.mark.parametrize("key,word", [("movie_by_actor", "aile"), ("movie_by_name", "eauo")])
def test_movie_queries_place_rows_and_chunks_only(spark, tmp_path, monkeypatch, key, word):
    from __spark_entry__ import queries

    texts = [(i, " ".join(WORDS[:60] + [f"{word}, end", "x", f"{word}s"][i % 3 : i % 3 + 1])) for i in range(150)] + [(150, None)]
    documents = spark.createDataFrame([(i, t, "en", "src0", 9) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    placed, plain_block = [], splitters.with_block
    monkeypatch.setattr(splitters, "with_block", lambda df, *args, **more: placed.append(df.count()) or plain_block(df, *args, **more))
    got = [(r["movie_id"], r["year"]) for r in queries()[key](spark, str(tmp_path)).collect()]
    hits = {0} if key == "movie_by_actor" else {0, 2}
    want = sorted(((i, 1990 + i % 35) for i, t in texts if t and i % 3 in hits), key=lambda m: (-m[1], m[0]))
    # 9,100 pairs of a text and a word; about 60 words, a chunk each
    assert got == want[:16] and len(placed) == 2 and sum(placed) < 400


@pytest.mark.parametrize("key,index_name,word", [("movie_by_actor", "casts", "aile"), ("movie_by_name", "titles", "eauo")])
def test_movie_indexes_of_many_rare_words_are_few_files(spark, tmp_path, key, index_name, word):
    from __spark_entry__ import queries

    # 40,000 words, each in one text, as names and misspellings are: 10 folders of 4,096 rows
    letters = str.maketrans("0123456789", "bcdfghjkmn")
    texts = [(i, " ".join(str(i * 100 + j).translate(letters) for j in range(100)) + (f" {word}" if i % 40 == 0 else "")) for i in range(400)]
    documents = spark.createDataFrame([(i, t, "en", "src0", 9) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["movie_id"], r["year"]) for r in queries()[key](spark, str(tmp_path)).collect()]
    assert got == sorted(((i, 1990 + i % 35) for i in range(0, 400, 40)), key=lambda m: (-m[1], m[0]))
    index = postings.index_of(spark, str(tmp_path), index_name, None)
    assert 0 < len(index.parts) <= 3
    assert spark.read.schema(postings.FIELDS).parquet(index.path).count() == 40_001
