"""Token ids as fixed-width packed blocks, written through Spark and read back.

Documents are put in ascending order of their id, encoded by the tokenizers
library, and packed with as few bits an id as the vocabulary needs. A block
holds whole documents and at least ``BLOCK_IDS`` ids (fewer in the last block
of a part). Its bytes are, all little-endian::

    magic b"TGPK", version u16, bits u16, documents u32, ids u64,
    (documents + 1) offsets u64: first id of each document in the block,
    the ids, bits each, lowest bit first, padded to a byte

so that any document or range of ids is unpacked with numpy from the bytes that
hold it. Blocks are rows of a Parquet table (any store Spark can write) with
part, place in the part and the ids before them in the part; reading adds up
the parts, which are as many as write tasks.

A null or empty text has only the end id. Rows without an id come first; rows
with equal ids follow each other in the order of their texts; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tallygrain.llm.common import expand, slices, table
from tallygrain.llm.registry import query
from tallygrain.session import work_folder

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
BLOCK_IDS = 1 << 16
PIECE_BYTES = 8 << 20
CACHE_WORDS = 400_000  # words remembered in a worker, and those of one slice
CHECK_EVERY = 128  # every 128th text of a slice goes through the library too
JOINED_WORDS = 500
PROBE = "a the word thing strengths internationalization zzzz qxj abcdefghijklmnopqrstuvwxyz naïve über señor straße"
HEAD = struct.Struct("<4sHHIQ")
MAGIC, VERSION = b"TGPK", 1

# letters below U+0250 have one code point in either case and no combining form (fixed values of Unicode)
SIMPLE = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+[.,]?$"


def read_tokenizer(name_or_path: str = TOKENIZER) -> str:
    """The tokenizer's JSON, by path or by its name among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """The library's ids of whole texts, each different word encoded once.

    For tokenizers that never join characters across white space: a text's ids
    are its words' ids one after the other. Words are remembered from slice to
    slice, as Arrow strings with their ids in one flat array, and looked up as
    they stand. Of the others, a word of plain letters takes the ids of its
    lower-case form without a final stop or comma, which is a word of its own
    there, if the tokenizer lower-cases and marks the ends of words.

    Some texts of every call go through the library whole, and a difference
    stops the job.
    """

    def __init__(self, json_text: str, most_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.most_words = Tokenizer.from_str(json_text), most_words
        vocab = self.library.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True
        got = self._plain([a + b for a in ("Ab", "çé") for b in ("", ".", ",")])
        tails = {t: self._plain([t])[0] for t in (".", ",")}
        words = all(got[3 * i + k] == got[3 * i] + tails[t] for i in (0, 1) for k, t in ((1, "."), (2, ",")))
        apart = self._plain(["one two\nthree"])[0] == sum(self._plain(["one", "two", "three"]), [])
        same = self._plain(["ABÇ"]) == self._plain(["abç"])
        self.simple = words and same and all(self.ends[x[-1]] for x in got)
        self.bare = self._bare()
        if not apart:
            raise ValueError("a tokenizer that joins characters across white space")
        # the words known, and of each where its ids begin in ``flat`` and how many they are
        self.words = pa.array([], pa.string())
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _bare(self) -> Tokenizer:
        """The library without what lower-case letters do not need: its merges behind a cut at spaces.

        Taken if it gives the same ids for a probe of such words; else the library as it is.
        """
        bare = Tokenizer(self.library.model)
        steps = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        bare.pre_tokenizer = pre_tokenizers.Sequence(steps)
        probe = " ".join([*PROBE.split(), *(chr(c) * 2 + "a" for c in range(0xDF, 0x250) if chr(c).islower())])
        same = bare.encode(probe, add_special_tokens=False).ids == self._plain([probe])[0]
        return bare if same else self.library

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of letters, and how many each has: the ends of words are seen by their marks."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        ids, counts = [], []
        for group, found in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            found = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self.ends[found]) + 1
            if len(stops) != len(group) or stops[-1] != len(found):
                found, own = self._any(group)
                stops = np.cumsum(own)
            ids.append(found)
            counts.append(np.diff(stops, prepend=0))
        nothing = np.zeros(0, np.uint32)
        return np.concatenate([nothing, *ids]), np.concatenate([nothing.astype(np.int64), *counts])

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any words, and how many each has: an id belongs to the word in which its characters begin."""
        ids, counts = [], []
        for i in range(0, len(words), JOINED_WORDS):
            group = words[i : i + JOINED_WORDS]
            found = self.library.encode(" ".join(group), add_special_tokens=False)
            starts = np.cumsum([0, *[len(w) + 1 for w in group]])
            at = np.fromiter((x for x, _ in found.offsets), np.int64, len(found.ids))
            ids.append(np.array(found.ids, np.uint32))
            counts.append(np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(group)))
        nothing = np.zeros(0, np.uint32)
        return np.concatenate([nothing, *ids]), np.concatenate([nothing.astype(np.int64), *counts])

    def _learn(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Remember words that were not known; their places."""
        first = len(self.words)
        begin = len(self.flat) + np.cumsum(counts) - counts
        self.words = pa.concat_arrays([self.words, words])
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, ids])
        return np.arange(first, len(self.words))

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, and the rows of those that are not known."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return at, np.flatnonzero(at < 0)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of different words, which are all known then."""
        at, new = self._known(words)
        if not len(new):
            return at
        missing = words.take(pa.array(new))
        plain = np.asarray(pc.match_substring_regex(missing, SIMPLE), bool) if self.simple else np.zeros(len(new), bool)
        letters = missing.filter(pa.array(plain))
        base = pc.utf8_rtrim(pc.utf8_lower(letters), ".,").dictionary_encode()
        base_at, unknown = self._known(base.dictionary)
        if len(unknown):
            fresh_words = base.dictionary.take(pa.array(unknown))
            base_at[unknown] = self._learn(fresh_words, *self._letters(fresh_words.to_pylist()))
        other = missing.filter(pa.array(~plain))
        if len(other):
            at[new[~plain]] = self._learn(other, *self._any(other.to_pylist()))
        if len(letters):
            # a word has its base's ids and those of its tail; a base that stands as a word itself is known by now
            of_base = base_at[np.asarray(base.indices, np.int64)]
            tails = pc.utf8_slice_codeunits(letters, -1)
            ids = [self._plain([t])[0] for t in ".,"]
            begin, count, flat = self.begin[of_base], self.count[of_base], np.concatenate([self.flat, *ids]).astype(np.uint32)
            pairs = np.stack([begin, np.full(len(letters), len(self.flat))], axis=1)
            sizes = np.stack([count, np.zeros(len(letters), np.int64)], axis=1)
            for t, start, own in ((".", 0, ids[0]), (",", len(ids[0]), ids[1])):
                has = np.asarray(pc.equal(tails, t), bool)
                pairs[has, 1] += start
                sizes[has, 1] = len(own)
            # a word that is its own base is known by now
            where = of_base.copy()
            left = np.flatnonzero(~np.asarray(pc.equal(letters, base.dictionary.take(base.indices)), bool))
            if len(left):
                taken = flat[expand(sizes[left].ravel(), pairs[left].ravel())]
                where[left] = self._learn(letters.take(pa.array(left)), taken, sizes[left].sum(axis=1))
            at[new[plain]] = where
        return at

    def _trim(self, words: pa.Array, at: np.ndarray) -> np.ndarray:
        """Forget all words but these, if there are too many."""
        if len(self.words) <= self.most_words:
            return at
        count = self.count[at]
        self.flat = self.flat[expand(count, self.begin[at])]
        self.words, self.count, self.begin = words, count, np.cumsum(count) - count
        return np.arange(len(words))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (with the end of the last)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(lists.offsets, np.int64)
        words = lists.flatten().dictionary_encode()
        at = self._trim(words.dictionary, self._places(words.dictionary))
        count, begin, flat = self.count[at], self.begin[at], self.flat
        which = np.asarray(words.indices, np.int64)
        bounds = bounds - bounds[0]
        if end_id is not None:  # one more word after each text
            begin, count, flat = np.append(begin, len(flat)), np.append(count, 1), np.append(flat, np.uint32(end_id))
            which = np.insert(which, bounds[1:], len(count) - 1)
            bounds = bounds + np.arange(len(bounds))
        sizes = count[which]
        ids, ends = flat[expand(sizes, begin[which])], np.concatenate([[0], np.cumsum(sizes)])[bounds]
        self._compare(texts, ids, ends, 0 if end_id is None else 1)
        return ids, ends

    def _compare(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray, tail: int) -> None:
        some = list(range(0, len(texts), CHECK_EVERY))
        for i, want in zip(some, self._plain([texts[i].as_py() for i in some])):
            if ids[ends[i] : ends[i + 1] - tail].tolist() != want:
                raise RuntimeError("ids of words differ from the library's ids of a whole text")


@cache
def encoder_of(json_text: str) -> WordEncoder:
    return WordEncoder(json_text)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    grid = ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & np.uint32(1)
    return np.packbits(grid.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` (not included) of packed bytes, from the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", last - first, first * (bits // 8)).astype(np.uint32)
    start, stop = first * bits // 8, -(-last * bits // 8)
    raw = np.unpackbits(np.frombuffer(data, np.uint8, stop - start, start), bitorder="little")
    skip = first * bits - 8 * start
    grid = raw[skip : skip + (last - first) * bits].reshape(-1, bits)
    return (grid.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def pack_block(ids: np.ndarray, offsets: np.ndarray, bits: int) -> bytes:
    head = HEAD.pack(MAGIC, VERSION, bits, len(offsets) - 1, len(ids))
    return head + offsets.astype("<u8").tobytes() + pack(ids, bits)


def read_head(block: bytes) -> tuple[int, np.ndarray, memoryview]:
    """Bits, offsets and packed ids of a block."""
    magic, version, bits, documents, _ = HEAD.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of packed ids")
    offsets = np.frombuffer(block, "<u8", documents + 1, HEAD.size).astype(np.int64)
    return bits, offsets, memoryview(block)[HEAD.size + 8 * (documents + 1) :]


def document_ids(block: bytes, place: int) -> np.ndarray:
    """Ids of the document at ``place`` in a block."""
    bits, offsets, data = read_head(block)
    return unpack(data, bits, int(offsets[place]), int(offsets[place + 1]))


BLOCK_FIELDS = "part int, place int, before long, n_ids long, doc_ids array<bigint>, block binary"


def write_packed(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int | None = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode texts in ascending order of id and write their blocks to ``path``."""
    json_text = read_tokenizer() if tokenizer is None else tokenizer

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(json_text)
        bits = bits_for(max(encoder.size, (end_id or 0) + 1))
        kept_ids: list[np.ndarray] = []
        kept_sizes: list[np.ndarray] = []
        kept_docs: list = []
        part, place, before, held = 0, 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(kept_ids)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(kept_sizes))])
            row = [part, place, before, len(ids), list(kept_docs), pack_block(ids, offsets, bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "place", "before", "n_ids", "doc_ids", "block"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in slices(batches, "_text", PIECE_BYTES):
            part = batch.column("_part")[0].as_py()
            ids, bounds = encoder.encode(batch.column("_text"), end_id)
            docs = batch.column("_id").to_pylist()
            start = 0
            while start < len(docs):
                # as many documents as fill the block, the one that fills it included
                stop = int(np.searchsorted(bounds, bounds[start] + block_ids - held, side="left"))
                stop = max(start + 1, min(stop, len(docs)))
                kept_ids.append(ids[bounds[start] : bounds[stop]])
                kept_sizes.append(np.diff(bounds[start : stop + 1]))
                kept_docs += docs[start:stop]
                held += int(bounds[stop] - bounds[start])
                start = stop
                if held >= block_ids:
                    yield block()
                    place, before, held = place + 1, before + held, 0
                    kept_ids.clear(), kept_sizes.clear(), kept_docs.clear()
        if kept_docs:
            yield block()

    given = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ordered = given.repartitionByRange("_id").sortWithinPartitions("_id", "_text")
    parted = ordered.withColumn("_part", F.spark_partition_id())
    parted.mapInArrow(blocks, BLOCK_FIELDS).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: the ids of all blocks before them."""
    blocks = spark.read.schema(BLOCK_FIELDS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # a row for each write task: few, and small enough to send to every task
    offsets = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def document_digests(blocks: DataFrame) -> DataFrame:
    """Per document of packed blocks: doc_id, start, n_tokens, CRC-32 of its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bits, offsets, data = read_head(batch.column("block")[i].as_py())
                raw = memoryview(unpack(data, bits, 0, int(offsets[-1])).astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                start = batch.column("start")[i].as_py()
                columns = [
                    pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()),
                    pa.array(start + offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    read = blocks.select("start", "doc_ids", "block")
    return read.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op9_packed_ids")
def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "packed-ids")
    write_packed(table(spark, sf_dir, "documents"), path)
    return document_digests(read_packed(spark, path))
