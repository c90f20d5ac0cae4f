"""Language identification of mixed text, word by word.

The letters of a word belong to scripts (code point ranges); languages that do
not use any of a word's scripts are no candidates for it. Every word gets a
score for each candidate: the log probability of its letter trigrams in that
language, learned from a bounded sample of labelled documents. Viterbi decoding
over the words, with a penalty for switching languages, yields spans. The
language with most letters is the text's language, their share its score.

A null text, or one without a letter, is ``und`` with score 0. If no script of
a word is known to any language, all languages are candidates. Without labelled
documents every text is ``und``. Ties go to the language first in the alphabet.
Texts of any length are judged whole, repeated rows each by itself, an empty
table gives an empty result, and columns besides id, text and (for learning) language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.llm.common import slices, table
from tallygrain.llm.registry import query

SAMPLE_DOCS = 400  # labelled documents a language is learned from
BUCKETS = 1 << 15  # trigrams are hashed to so many counts
SWITCH_PENALTY = 9.0
SCRIPT_SHARE = 0.02  # a language uses a script that has this share of its letters
PIECE_BYTES = 1 << 21

# first and last code point of each script's letters (fixed values of Unicode)
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x30000, 0x323AF)),
}
OTHER_SCRIPT = 1 << len(SCRIPTS)
POINTS = 0x110000


class Model(NamedTuple):
    langs: list[str]
    scripts: np.ndarray  # [language] bits of the scripts it uses
    scores: np.ndarray  # [bucket, language] log probabilities


@cache
def script_bits() -> np.ndarray:
    """For each code point the bit of its script, 0 for what is no letter."""
    bits = np.fromiter((OTHER_SCRIPT if chr(c).isalpha() else 0 for c in range(POINTS)), np.int32, POINTS)
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            part = bits[first : last + 1]
            part[part > 0] = 1 << i
    return bits


class Words(NamedTuple):
    starts: np.ndarray  # where each word starts
    doc: np.ndarray  # the text it belongs to
    letters: np.ndarray  # its letters
    scripts: np.ndarray  # bits of its scripts
    trigrams: np.ndarray  # bucket of the trigram at each place, from the place before the first word
    cuts: np.ndarray  # where each word's trigrams start


def words_of(texts: list[str]) -> Words | None:
    """Words and hashed letter trigrams of some texts; None without a word."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    bits = script_bits()[points]
    gap = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.flatnonzero(np.diff(gap.view(np.int8)) == -1) + 1
    if not len(edge):
        return None
    letter = bits > 0
    shown = np.where(letter, points, 32).astype(np.uint32)
    mixed = shown[:-2] * np.uint32(0x9E3779B1) ^ shown[1:-1] * np.uint32(0x85EBCA6B) ^ shown[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    trigrams = (mixed >> np.uint32(17)).astype(np.int32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    first = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return Words(
        edge,
        np.searchsorted(first, edge, side="right") - 1,
        np.add.reduceat(letter.astype(np.int32), edge),
        np.bitwise_or.reduceat(bits, edge),
        trigrams,
        edge - 1,
    )


def decode(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The likeliest language of each word; text ``i`` has the words ``bounds[i]`` to ``bounds[i + 1]``.

    All texts are decoded side by side, longest first, a word of each at a time.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, size = bounds[:-1][order], sizes[order]
    number = np.int16 if scores.shape[1] < 1 << 15 else np.int32
    back = np.zeros(scores.shape, number)
    own = np.arange(scores.shape[1], dtype=number)
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    best = scores[begin[: alive[0]]].copy() if len(alive) else np.zeros((0, scores.shape[1]))
    last = np.zeros(len(size), number)
    for t in range(1, len(alive)):
        live = alive[t]
        if live < len(best):
            last[live : len(best)] = best[live:].argmax(axis=1)
            best = best[:live]
        top = best.argmax(axis=1)
        from_top = best[np.arange(live), top][:, None] - penalty
        stay = best >= from_top
        at = begin[:live] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, from_top) + scores[at]
    if len(best):
        last[: len(best)] = best.argmax(axis=1)
    found = np.zeros(len(scores), number)
    for t in range(len(alive) - 1, -1, -1):
        live = alive[t]
        at = begin[:live] + t
        found[at] = last[:live]
        last[:live] = back[at, last[:live]]
    return found


def label_words(texts: list[str], model: Model) -> tuple[Words | None, np.ndarray | None, np.ndarray]:
    """Words, the language of each word, and letters of each language in each text."""
    letters = np.zeros((len(texts), max(1, len(model.langs))), np.int64)
    words = words_of(texts) if model.langs else None
    if words is None:
        return None, None, letters
    scores = np.add.reduceat(model.scores[words.trigrams], words.cuts, axis=0)[: len(words.starts)]
    fits = (words.scripts[:, None] & model.scripts) > 0
    scores[~fits & fits.any(axis=1)[:, None]] = -1e6
    scores[words.letters == 0] = 0
    bounds = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    found = decode(scores, bounds)
    np.add.at(letters, (words.doc, found), words.letters)
    return words, found, letters


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from; also those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """Learn from at most ``sample_docs`` documents of each language that are not held out, chosen by a hash."""
    given = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    given = given.filter(~held_out(F.col("_id")) & F.col("_text").isNotNull() & F.col("_lang").isNotNull())
    # about twice the sample by a hash, then exactly the sample: no task sees a whole language
    share = F.lit(0.0)
    for r in given.groupBy("_lang").count().collect():
        share = F.when(F.col("_lang") == r["_lang"], min(1.0, 2 * sample_docs / r["count"])).otherwise(share)
    drawn = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    by_hash = W.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    placed = given.select("_id", "_lang").filter(drawn).withColumn("_n", F.row_number().over(by_hash))
    picked = placed.filter(F.col("_n") <= sample_docs)
    # at most sample_docs ids a language: small enough to send to every task
    sample = given.join(F.broadcast(picked.select("_id").distinct()), "_id", "left_semi").select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "_text", PIECE_BYTES):
            langs = np.array(batch.column("_lang").to_pylist(), object)
            texts = np.array(batch.column("_text").to_pylist(), object)
            for lang in set(langs):
                words = words_of(list(texts[langs == lang]))
                if words is None:
                    continue
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
                total[:BUCKETS] += np.bincount(words.trigrams, minlength=BUCKETS)
                for i in range(len(SCRIPTS) + 1):
                    total[BUCKETS + i] += words.letters[(words.scripts >> i & 1) > 0].sum()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            columns = [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])

    counts = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # at most BUCKETS and the scripts, for each language
    rows = counts.collect()
    langs = sorted({r["lang"] for r in rows})
    cells = np.zeros((BUCKETS + len(SCRIPTS) + 1, len(langs)))
    for r in rows:
        cells[r["cell"], langs.index(r["lang"])] = r["n"]
    smooth = cells[:BUCKETS] + 0.5
    used = cells[BUCKETS:] >= SCRIPT_SHARE * cells[BUCKETS:].sum(axis=0)
    scripts = (used * (1 << np.arange(len(SCRIPTS) + 1))[:, None]).sum(axis=0).astype(np.int32)
    return Model(langs, scripts, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def spans_of(words: Words | None, found: np.ndarray | None, n: int, langs: list[str]) -> pa.Array:
    """For each text its runs of words in one language: first word, number of words, language."""
    if words is None:
        return pa.array([[]] * n, pa.list_(SPAN))
    turn = np.flatnonzero(np.r_[True, (np.diff(words.doc) != 0) | (np.diff(found) != 0)])
    doc = words.doc[turn]
    offset = np.searchsorted(words.doc, np.arange(n))[doc]
    ends = np.r_[turn[1:], len(found)]
    parts = [
        pa.array((turn - offset).astype(np.int64)),
        pa.array((ends - turn).astype(np.int64)),
        pa.array(langs).take(pa.array(found[turn].astype(np.int32))),
    ]
    bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(parts, fields=list(SPAN)))


SPAN = pa.struct([pa.field("first_word", pa.int64()), pa.field("n_words", pa.int64()), pa.field("lang", pa.string())])


def judge(texts: pa.Array, model: Model) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language, score and spans of each text."""
    given = [t or "" for t in texts.to_pylist()]
    words, found, letters = label_words(given, model)
    total, best = letters.sum(axis=1), letters.argmax(axis=1)
    known = total > 0
    langs = pa.array([*model.langs, "und"]).take(pa.array(np.where(known, best, len(model.langs)).astype(np.int32)))
    share = np.where(known, letters[np.arange(len(given)), best] / np.maximum(total, 1), 0.0)
    return langs, pa.array(share), spans_of(words, found, len(given), model.langs)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, spans (array of first_word, n_words, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", PIECE_BYTES):
            names = ["_id", "lang_pred", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *judge(batch.column("_text"), model)], names)

    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = given.schema["_id"].dataType.simpleString()
    spans = "array<struct<first_word:bigint,n_words:bigint,lang:string>>"
    found = given.mapInArrow(run, f"_id {id_type}, lang_pred string, score double, spans {spans}")
    return found.withColumnRenamed("_id", id_col)


def keep_known(df: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in one learned language by ``min_score`` of its letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, PIECE_BYTES):
            langs, share, _ = judge(batch.column(text_col), model)
            good = [lang != "und" and s >= min_score for lang, s in zip(langs.to_pylist(), share.to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return df.mapInArrow(run, df.schema)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )
