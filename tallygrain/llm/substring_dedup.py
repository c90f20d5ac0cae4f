"""Repeated passages: difference-cover anchors find them, whole windows confirm them.

A window is ``WINDOW`` consecutive words. Windows that another document has
too are found without hashing all of them: only at word places whose remainder
modulo ``PERIOD`` is in ``COVER`` are shorter windows hashed, the anchors. Any
remainder is the difference of two members of the cover, so wherever two
documents share a window, both have an anchor at the same place of it. Around
anchors that two documents share, the match is extended: the windows that
contain such an anchor are hashed with 128 bits and grouped. A word goes if a
window over it also starts in a document with a smaller id.

Whole copies (equal word sequences) are recognised first: all but the one with
the smallest id lose every word, and only that one goes on.

A null or empty text has no words. Documents shorter than a window lose
nothing, and neither do rows without an id, which take no words from others
either. Rows of one id never take words from each other; repeated rows get the
same result; if one text of an id is a whole copy, its other texts take no part. An empty table gives an empty result; columns besides id and text
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, among, byte_texts, fresh, slices, table
from tallygrain.llm.registry import query

WINDOW = 50
# every remainder of 31 is the difference of exactly one pair of these
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1


class Words:
    """The words of a text in a row, each followed by a space, and where each starts and ends."""

    def __init__(self, text: bytes) -> None:
        self.words = text.split()
        self.joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes

    def __len__(self) -> int:
        return len(self.words)

    def hashes(self, places: np.ndarray, width: int) -> np.ndarray:
        """64-bit hashes of ``width`` words from each place on."""
        raw, h = self.joined, xxhash.xxh3_64_intdigest
        spans = zip(self.starts[places].tolist(), self.ends[places + width - 1].tolist())
        return np.fromiter((h(raw[a:b]) for a, b in spans), np.uint64, len(places)).view(np.int64)

    def digests(self, places: np.ndarray, width: int) -> np.ndarray:
        """128-bit hashes of ``width`` words from each place on, as two numbers."""
        raw, h = self.joined, xxhash.xxh3_128_digest
        spans = zip(self.starts[places].tolist(), self.ends[places + width - 1].tolist())
        return np.frombuffer(b"".join([h(raw[a:b]) for a, b in spans]), np.int64).reshape(-1, 2)

    def whole(self) -> tuple[int, int]:
        hi, lo = np.frombuffer(xxhash.xxh3_128_digest(self.joined), np.int64).tolist()
        return hi, lo


def anchor_places(n: int) -> np.ndarray:
    """Places modulo the period in the cover where an anchor fits into ``n`` words; none without a window."""
    if n < WINDOW:
        return np.zeros(0, np.int64)
    places = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places + ANCHOR <= n]


def windows_around(anchors: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows of ``n`` words that contain one of the anchors."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(anchors - PERIOD + 1, 0), 1)
    np.add.at(mark, anchors + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n - WINDOW + 1)] > 0)


def _given(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _base(docs: DataFrame) -> DataFrame:
    """Per row: id, number of words, 128 bits and SHA-256 of the words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in byte_texts(batch.column("text")):
                words = text.split()
                joined = b" ".join(words)
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(joined), np.int64).tolist()
                out.append((len(words), hi, lo, hashlib.sha256(joined).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "hi", "lo", "sha"])

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, sha string")


def _anchors(docs: DataFrame) -> DataFrame:
    """id and its different anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in byte_texts(batch.column("text")):
                words = Words(text)
                found.append(np.unique(words.hashes(anchor_places(len(words)), ANCHOR)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "anchors"])

    return docs.mapInArrow(run, "id long, anchors array<bigint>").filter(F.size("anchors") > 0)


def _candidates(words: Words, flags: np.ndarray) -> np.ndarray:
    """Starts of the windows that contain a flagged anchor."""
    places = anchor_places(len(words))
    return windows_around(places[np.isin(words.hashes(places, ANCHOR), flags)], len(words))


def _windows(flagged: DataFrame) -> DataFrame:
    """id and 128 bits of each different candidate window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, parts = [], []
            rows = zip(batch.column("id").to_pylist(), byte_texts(batch.column("text")), batch.column("flags"))
            for doc, text, flags in rows:
                words = Words(text)
                found = words.digests(_candidates(words, np.asarray(flags.values)), WINDOW)
                found = np.unique(found, axis=0) if len(found) else found
                parts.append(found)
                ids.append(np.full(len(found), doc))
            both = np.concatenate(parts)
            columns = [pa.array(np.concatenate(ids)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "w1", "w2"])

    return flagged.mapInArrow(run, "id long, w1 long, w2 long")


def _removed(flagged: DataFrame) -> DataFrame:
    """id, 128 bits of all words, words removed and the text of those kept, of documents with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            columns = (batch.column("flags"), batch.column("hits"))
            for text, flags, hits in zip(byte_texts(batch.column("text")), *columns):
                words = Words(text)
                starts = _candidates(words, np.asarray(flags.values))
                hit = np.isin(words.digests(starts, WINDOW)[:, 0], np.asarray(hits.values))
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, starts[hit], 1)
                np.add.at(edge, starts[hit] + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words.words, gone.tolist()) if not g])
                out.append((*words.whole(), int(gone.sum()), kept.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            made = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], ["id", "hi", "lo", "n_removed", "kept"])

    return flagged.mapInArrow(run, "id long, hi long, lo long, n_removed long, kept string")


def repeats(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Base rows (id, n, hi, lo, sha, copy); and per id and word sequence that loses some words, the kept text.

    ``docs`` has the columns id and text.
    """
    base = scratch(_base(docs), "base")
    narrow, wide = (base.count() / n for n in (100_000, 10_000))  # files that a row a document can fill
    long = base.filter((F.col("n") >= WINDOW) & F.col("id").isNotNull())
    first = long.groupBy("hi", "lo").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last")
    first = scratch(first.drop("last"), "first", narrow)
    copies = scratch(long.join(first, ["hi", "lo"]).filter("id != first").select("id", "hi", "lo").distinct(), "copies", narrow)
    copy = copies.withColumn("copy", F.lit(True))
    base = base.join(copy, ["id", "hi", "lo"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    only = scratch(copies.select("id").distinct(), "gone", narrow)
    rest = among(docs.filter("id is not null"), only, "id", keep=False)

    anchors = scratch(_anchors(rest), "anchors").select("id", F.explode("anchors").alias("anchor"))
    ends = anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    shared = scratch(ends.filter("a != b").select("anchor"), "shared")
    flags = anchors.join(shared, "anchor").groupBy("id").agg(F.collect_list("anchor").alias("flags"))
    flags = scratch(flags, "flags", wide)
    flagged = among(rest, flags.select("id"), "id").join(flags, "id")
    flagged = scratch(flagged, "flagged", wide)

    windows = _windows(flagged)
    owners = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first != last")
    owners = scratch(owners.drop("last"), "owners")
    hits = windows.join(owners, ["w1", "w2"]).filter("id > first").groupBy("id").agg(F.collect_list("w1").alias("hits"))
    removed = scratch(_removed(flagged.join(scratch(hits, "hits", wide), "id")), "removed")
    return base, removed.dropDuplicates(["id", "hi", "lo"])


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces)."""
    scratch = Scratch(df.sparkSession, "substring-dedup")
    base, removed = repeats(_given(df, id_col, text_col), scratch)
    scratch.clear("base", "copies", "removed")
    found = removed.select("id", "hi", "lo", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    return base.join(found, ["id", "hi", "lo"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows with all their columns, without their repeated words; rows left without any word go.

    A text that loses nothing stays as it is, else its kept words are joined by
    spaces and ``chars_col``, where there is one, is counted anew.
    """
    scratch = Scratch(df.sparkSession, "substring-dedup")
    base, removed = repeats(_given(df, id_col, text_col), scratch)
    copies = base.filter("copy").select("id", "hi", "lo", F.lit("").alias("_kept"))
    changed = scratch(removed.select("id", "hi", "lo", F.col("kept").alias("_kept")).unionByName(copies), "changed")
    ids = scratch(changed.select("id").distinct(), "ids")
    scratch.clear("changed", "ids")
    key, hi, lo, kept = (fresh(df, name) for name in ("_id", "_hi", "_lo", "_kept"))
    keyed = df.withColumn(key, F.col(id_col).cast("long"))
    ids = ids.withColumnRenamed("id", key)
    same = among(keyed, ids, key, keep=False).drop(key)
    other = among(keyed, ids, key)

    def sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            whole = [Words(t).whole() for t in byte_texts(batch.column(text_col))]
            halves = [pa.array([w[i] for w in whole], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], [*batch.schema.names, hi, lo])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in other.schema)
    other = other.mapInArrow(sequence, f"{named}, `{hi}` long, `{lo}` long")
    texts = changed.select(F.col("id").alias(key), F.col("hi").alias(hi), F.col("lo").alias(lo), F.col("_kept").alias(kept))
    joined = other.join(texts, [key, hi, lo], "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    edits = {text_col: F.coalesce(kept, text_col)}
    if chars_col in df.columns:
        counted = F.when(F.col(kept).isNull(), F.col(chars_col)).otherwise(F.length(kept))
        edits[chars_col] = counted.cast(df.schema[chars_col].dataType)
    return same.unionByName(joined.withColumns(edits).select(*df.columns))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
