import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tallygrain.llm import fingerprints as fp
from tests.conftest import SF
from tests.llm.conftest import LONG, ODD, prose

MASK = (1 << 64) - 1


def chained(*values, seed=42):
    """The hash of a row of values, as Spark chains it."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_set(text):
    w = plain_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain(text):
    """The fingerprint as the module's text describes it."""
    low = (1 << fp.SHIFT) - 1
    bins = [None] * fp.BINS
    for s in plain_set(text):
        h = signed(chained(*s))
        b = (h >> fp.SHIFT) + fp.BINS // 2
        if h & low != low and (bins[b] is None or h < bins[b]):
            bins[b] = h
    if all(b is None for b in bins):
        return ""
    filled = [i for i, b in enumerate(bins) if b is not None]
    out = []
    for i, own in enumerate(bins):
        if own is None:
            asked = [signed(chained(i, t)) % fp.BINS for t in range(fp.ASKED)]
            found = next((j for j in asked if bins[j] is not None), None)
            if found is None:
                found = min(filled, key=lambda j: signed(chained(j, i)))
            own = bins[found]
        out.append(f"{chained((own,), i) & 15:x}")
    return "".join(out)


def alike(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    share = sum(x == y for x, y in zip(a, b)) / fp.BINS
    return max(0.0, (share - 1 / 16) / (15 / 16))


def expected(rows):
    """All result rows, in the order of id and text hash."""
    tied = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(chained(r[1] or ""))))
    out = []
    for (doc, text), (_, after) in zip(tied, tied[1:] + tied[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def result(df):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def same(got, want):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]


def test_query_equals_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    same(result(fp.op11_fingerprints(spark, SF)), expected(rows))


@pytest.mark.parametrize("block", [1, 3, 512])
def test_odd_rows_in_blocks_of_any_size(documents, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK_ROWS", block)
    rows = [(100 - i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (None, None), (7, "other"), (-5, LONG)]
    rows += [(7, "twice"), (7, "twice"), (7, "twice"), (40, "a"), (40, "a")] + [(200 + i, prose(i, 30)) for i in range(20)]
    df = documents(rows, clashing=True)
    same(result(fp.edits(df)), expected(rows))


def test_no_row_and_one_row(documents):
    assert fp.edits(documents([(1, "x")]).limit(0)).count() == 0
    same(result(fp.edits(documents([(1, "one text of seven words in all")]))), expected([(1, "one text of seven words in all")]))


def test_a_third_of_all_rows_under_one_id(documents, monkeypatch):
    monkeypatch.setattr(fp, "COPIES_A_ROW", 7)
    rows = [(5 if i % 3 == 0 else i, "the same row" if i % 3 == 0 else prose(i, 8)) for i in range(600)]
    same(result(fp.edits(documents(rows))), expected(rows))


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([20, 200, 1000]))]
        cut = rng.randrange(len(a))
        rows.append((" ".join(a), " ".join(a[:cut] + [f"v{rng.randrange(10**6)}" for _ in a[cut:]])))
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("e")).collect()
    errors = []
    for r in got:
        x, y = plain_set(r["a"]), plain_set(r["b"])
        errors.append(r["e"] - len(x & y) / len(x | y))
    assert abs(sum(errors) / len(errors)) < 0.015
    assert sum(map(abs, errors)) / len(errors) < 0.05 and max(map(abs, errors)) < 0.3


def test_plan_is_native_and_gathers_nothing(spark):
    df = fp.op11_fingerprints(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop", "SinglePartition"))
    # one shuffle, by blocks, serves both windows
    assert plan.count("Exchange ") == 1
