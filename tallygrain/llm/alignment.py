"""Cross-tokenizer alignment: which tokens of two vocabularies end at the same bytes.

Both tokenizers encode a text behind one space. The lists of ids are flattened
with their parents, token widths are added up within each text (a segmented
cumulative sum), and the two sides meet in a hash join on (document, end): each
hit is a *link*. Byte offsets where tokens of both sides end cut them into
groups. All of this is Arrow tables inside a task, a few MB of text at a time.

A piece of texts becomes one row, a *block*: per document its counts and the
checksum of its groups, the different pairs (a, b) linked in the block with
their counts (``Table.group_by``), and each link as the place of its pair in
that list. Spark adds up the pairs' counts over all blocks, finds the highest
count of each id of B, and sends each block the counts of its own pairs, where
the documents' sums are taken. So what is shuffled is the pairs of a block, not
of a document, and no table of counts is held whole by a task.

A null or empty text, and one whose token bytes are not a space and the text,
has no tokens: zeros and an empty checksum. Neither tokenizer joins characters over
a single space between two words, so each different word goes through the
libraries once, many in a call; some texts of every piece go through them whole,
and a difference stops the job. Repeated rows are documents of their own, and count again; rows
without an id are kept. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2
from tokenizers import Tokenizer

from tallygrain.llm.common import Scratch, expand, slices, table
from tallygrain.llm.registry import query

BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE_BYTES = 2 << 20  # of a block
PART_CHARS = 100_000  # of a text that is encoded at once
CALL_CHARS = 200_000  # of the texts of one library call
CACHE_WORDS = 400_000  # words remembered in a worker, and those of one piece
CHECK_EVERY = 64  # every 64th text of a piece goes through the libraries whole
# white space (fixed values of Unicode), the separators U+001C to U+001F to be on the safe side, and the mark that
# sentencepiece takes for a space
WHITE = "\\x{2581}\\x09-\\x0D\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
ODD_SPACE = f"^ | $|[{WHITE}] | [{WHITE}]"
_WHITE = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WHITE)
WORD_CUT = re.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
CUT = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
SPACE = "▁"


def read_file(name_or_path: str) -> bytes:
    """A tokenizer's file, by path or by its name among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side(NamedTuple):
    """A tokenizer: ids of texts, the bytes of each id, and whether words behind single spaces are encoded by themselves."""

    encode: object
    raw: pa.BinaryArray
    width: np.ndarray
    by_word: bool


def _side(encode, raw: list[bytes], by_word: bool) -> Side:
    return Side(encode, pa.array(raw, pa.binary()), np.fromiter(map(len, raw), np.int64, len(raw)), by_word)


def byte_side(data: bytes) -> Side:
    """A byte-level BPE of the tokenizers library, which gets each text behind a space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_str(data.decode())
    library.encode_special_tokens = True
    vocab, letters = library.get_vocab(), byte_letters()
    raw = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        raw[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    rules = json.loads(data)
    split = rules.get("pre_tokenizer") or {}
    by_word = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not rules.get("normalizer")
    return _side(encode, raw, by_word)


def piece_side(data: bytes) -> Side:
    """A sentencepiece model, which puts the space before each text itself."""
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    proto = model_pb2.ModelProto()
    proto.ParseFromString(data)
    byte = model_pb2.ModelProto.SentencePiece.BYTE
    raw = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte else p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
    # words are apart if the model neither normalises nor has a piece with a space behind a character
    rules = proto.normalizer_spec
    apart = not any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces)
    by_word = apart and rules.add_dummy_prefix and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces
    return _side(lambda texts: library.encode(texts, num_threads=1), raw, by_word)


@cache
def sides_of(a: bytes, b: bytes) -> tuple[Side, Side]:
    return byte_side(a), piece_side(b)


def parts_of(text: str, most: int = PART_CHARS) -> list[str]:
    """The text without the single spaces it is cut at: each part but the last has ``most`` characters at least."""
    out, start = [], 0
    while len(text) - start > most:
        cut = CUT.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def words_of(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Words of all texts, and where each text's words start (with the end of the last).

    A text is its words joined by single spaces. It is cut at a space between
    two characters that are no white space; a byte-level vocabulary puts such a
    space before what follows, and so does sentencepiece.
    """
    plain = pa.array(texts, pa.string())
    odd = np.asarray(pc.match_substring_regex(plain, ODD_SPACE), bool) if len(texts) else np.zeros(0, bool)
    lists = pc.split_pattern(pc.if_else(pa.array(odd), "", plain), " ")
    if not odd.any():
        return lists.values, np.asarray(lists.offsets, np.int64)
    parts = lists.to_pylist()
    for i in np.flatnonzero(odd).tolist():
        parts[i] = WORD_CUT.split(texts[i])
    ends = np.cumsum([0, *map(len, parts)])
    return pa.array([w for own in parts for w in own], pa.string()), ends


class Known:
    """Ids of words on one side, remembered from piece to piece as flat arrays."""

    def __init__(self, side: Side) -> None:
        self.side = side
        self.begin, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Words joined by spaces go to the library; the widths of the tokens tell where each word ends."""
        ids, counts = [self.flat], []
        start = 0
        while start < len(words):
            stop, held = start, 0
            while stop < len(words) and (stop == start or held + len(words[stop]) < CALL_CHARS):
                held += len(words[stop]) + 1
                stop += 1
            own = words[start:stop]
            found = np.array(self.side.encode([" ".join(own)])[0], np.int32)
            ends = np.cumsum([len(w.encode()) + 1 for w in own])
            upto = np.cumsum(self.side.width[found])
            at = np.searchsorted(upto, ends)
            if not len(upto) or upto[-1] != ends[-1] or not (upto[np.minimum(at, len(upto) - 1)] == ends).all():
                # some word's tokens do not spell it: each by itself
                lists = self.side.encode(own)
                ids += [np.array(x, np.int32) for x in lists]
                counts += [len(x) for x in lists]
            else:
                ids.append(found)
                counts += np.diff(at + 1, prepend=0).tolist()
            start = stop
        count = np.array(counts, np.int64)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
        self.count, self.flat = np.concatenate([self.count, count]), np.concatenate(ids)

    def keep(self, at: np.ndarray) -> None:
        """Forget all words but these."""
        count = self.count[at]
        self.flat = self.flat[expand(count, self.begin[at])]
        self.begin, self.count = np.cumsum(count) - count, count

    def lists(self, at: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
        """The ids of texts, given the places of their words."""
        sizes = self.count[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(self.flat[expand(sizes, self.begin[at])]))


class Memory:
    """Words that both sides know, in one order."""

    def __init__(self, sides: tuple[Side, Side], most_words: int = CACHE_WORDS) -> None:
        self.sides, self.most_words = sides, most_words
        self.words, self.known = pa.array([], pa.string()), [Known(s) for s in sides]

    def id_lists(self, texts: list[str]) -> list[pa.ListArray]:
        if not all(s.by_word for s in self.sides):
            return whole_lists(texts, self.sides)
        words, bounds = words_of(texts)
        coded = words.dictionary_encode()
        own = coded.dictionary
        at = pc.fill_null(pc.index_in(own, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        missing = own.take(pa.array(new))
        at[new] = np.arange(len(self.words), len(self.words) + len(new))
        self.words = pa.concat_arrays([self.words, missing])
        for known in self.known:
            known.learn(missing.to_pylist())
        if len(self.words) > self.most_words:
            self.words = own
            for known in self.known:
                known.keep(at)
            at = np.arange(len(own))
        places = at[np.asarray(coded.indices, np.int64)]
        found = [known.lists(places, bounds) for known in self.known]
        some = list(range(0, len(texts), CHECK_EVERY))
        for lists, want in zip(found, whole_lists([texts[i] for i in some], self.sides)):
            if lists.take(pa.array(some, pa.int64())).to_pylist() != want.to_pylist():
                raise RuntimeError("ids of words differ from the library's ids of a whole text")
        return found


def whole_lists(texts: list[str], sides: tuple[Side, Side]) -> list[pa.ListArray]:
    """Ids of each text on both sides, by the libraries."""
    parts = [parts_of(t) for t in texts]
    flat = [p for own in parts for p in own]
    firsts = np.cumsum([0, *map(len, parts)])
    out = []
    for side in sides:
        ids: list[np.ndarray] = []
        start = 0
        while start < len(flat):
            stop, held = start, 0
            while stop < len(flat) and (stop == start or held + len(flat[stop]) <= CALL_CHARS):
                held += len(flat[stop])
                stop += 1
            ids += [np.array(x, np.int32) for x in side.encode(flat[start:stop])]
            start = stop
        ends = np.concatenate([[0], np.cumsum(list(map(len, ids)))]).astype(np.int64)
        values = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
        out.append(pa.ListArray.from_arrays(pa.array(ends[firsts].astype(np.int32)), values))
    return out


@cache
def memory_of(a: bytes, b: bytes) -> Memory:
    return Memory(sides_of(a, b))


def joined(raw: pa.BinaryArray, stops: np.ndarray, without: int = 0) -> list[bytes]:
    """The bytes of the values between each two ``stops``, without the last ``without`` of them."""
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
    data = raw.buffers()[2]
    whole = memoryview(data) if data is not None else memoryview(b"")
    at = offsets[stops].tolist()
    return [bytes(whole[x : max(x, y - without)]) for x, y in zip(at[:-1], at[1:])]


def spell(lists: pa.ListArray, side: Side) -> list[bytes]:
    """The joined bytes of each list."""
    return joined(side.raw.take(lists.values), np.asarray(lists.offsets, np.int64))


def tokens(lists: pa.ListArray, side: Side, name: str) -> pa.Table:
    """doc, end (bytes from the text's start) and id of every token."""
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    upto = pc.cumulative_sum(pa.array(side.width).take(flat))
    # what had been added up before a token's own text
    firsts = pc.fill_null(pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(lists.offsets), 0)
    return pa.table({"doc": doc, "end": pc.subtract(upto, firsts.take(doc)), name: flat})


def linked(a: pa.Table, b: pa.Table) -> pa.Table:
    """doc, end, a, b of all token pairs that end together, in order."""
    met = a.join(b, ["doc", "end"], join_type="inner", use_threads=False)
    return met.sort_by([("doc", "ascending"), ("end", "ascending")])


@cache
def _written_ids(n_a: int, n_b: int) -> pa.BinaryArray:
    """Decimal ids with what can follow them: A's with ``,`` and ``|``, B's with ``,`` and ``;``."""
    return pa.array([f"{i}{c}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for c in ends for i in range(n)], pa.binary())


def group_texts(n: int, a: pa.Table, b: pa.Table, cuts: pa.Table, sizes: tuple[int, int]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each of ``n`` documents; ``cuts`` are doc and end of all group ends."""
    doc_a, doc_b, doc_c = (np.asarray(t["doc"]) for t in (a, b, cuts))
    spans = np.zeros(n + 1, np.int64)
    np.maximum.at(spans, doc_c + 1, np.asarray(cuts["end"]) + 1)
    base = np.cumsum(spans)
    ends = base[doc_c] + np.asarray(cuts["end"])
    end_a, end_b = base[doc_a] + np.asarray(a["end"]), base[doc_b] + np.asarray(b["end"])
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    upto_a = np.searchsorted(group_a, np.arange(len(ends) + 1))
    upto_b = np.searchsorted(group_b, np.arange(len(ends) + 1))
    # a group's tokens of A come first, then those of B
    place_a = np.arange(len(group_a)) + upto_b[group_a]
    place_b = np.arange(len(group_b)) + upto_a[group_b + 1]
    n_a, n_b = sizes
    last_a = np.append(np.diff(group_a) != 0, True)[: len(group_a)]
    last_b = np.append(np.diff(group_b) != 0, True)[: len(group_b)]
    which = np.empty(len(group_a) + len(group_b), np.int64)
    which[place_a] = np.asarray(a["a"]) + np.where(last_a, n_a, 0)
    which[place_b] = 2 * n_a + np.asarray(b["b"]) + np.where(last_b, n_b, 0)
    text = _written_ids(n_a, n_b).take(pa.array(which))
    stops = np.searchsorted(doc_a, np.arange(n + 1)) + np.searchsorted(doc_b, np.arange(n + 1))
    return joined(text, stops, 1)


def per_doc(table_: pa.Table, n: int) -> np.ndarray:
    return np.bincount(np.asarray(table_["doc"]), minlength=n).astype(np.int64)


class Aligned(NamedTuple):
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]
    links: pa.Table


def align(texts: list[str | None], memory: Memory) -> Aligned:
    """Tokens, groups and links of some texts."""
    given = [t or "" for t in texts]
    n, sides = len(given), memory.sides
    lists = memory.id_lists(given)
    want = [b" " + t.encode() for t in given]
    good = [bool(t) and x == w and y == w for t, w, x, y in zip(given, want, *[spell(i, s) for i, s in zip(lists, sides)])]
    keep = pa.array(good, pa.bool_())
    a, b = (tokens(i, s, name) for i, s, name in zip(lists, sides, "ab"))
    a, b = (t.filter(keep.take(t["doc"])) for t in (a, b))
    links = linked(a, b)
    cuts = links.group_by(["doc", "end"], use_threads=False).aggregate([]) if links.num_rows else links.select(["doc", "end"])
    cuts = cuts.sort_by([("doc", "ascending"), ("end", "ascending")])
    groups = group_texts(n, a, b, cuts, (len(sides[0].raw), len(sides[1].raw)))
    return Aligned(per_doc(a, n), per_doc(b, n), per_doc(cuts, n), groups, links)


def _codes(places: np.ndarray, different: int) -> bytes:
    return places.astype(np.uint16 if different <= 1 << 16 else np.uint32).tobytes()


BLOCK_FIELDS = (
    "block long, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>,"
    " n_links array<bigint>, groups_sha256 array<string>, links binary, a array<int>, b array<int>, n array<bigint>"
)


def aligned_blocks(df: DataFrame, id_col: str, text_col: str, a: bytes, b: bytes, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each piece of texts; its number is the task's and the piece's, so write it before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_of(a, b)
        turn = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "_text", piece_bytes):
            found = align(batch.column("_text").to_pylist(), memory)
            key = pc.add(pc.shift_left(found.links["a"].cast(pa.int64()), 32), found.links["b"].cast(pa.int64()))
            pairs = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
            keys = np.asarray(pairs["key"])
            places = np.asarray(pc.index_in(key, pairs["key"].combine_chunks()), np.int64)
            row = [
                pa.scalar(turn, pa.int64()),
                batch.column("_id"),
                pa.array(found.n_a),
                pa.array(found.n_b),
                pa.array(found.n_groups),
                pa.array(per_doc(found.links, batch.num_rows)),
                pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found.groups], pa.string()),
                _codes(places, len(keys)),
                pa.array((keys >> 32).astype(np.int32)),
                pa.array((keys & 0xFFFFFFFF).astype(np.int32)),
                pairs["count_all"].combine_chunks().cast(pa.int64()),
            ]
            columns = []
            for value in row:
                if isinstance(value, pa.Array):
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
                else:
                    columns.append(pa.array([value.as_py() if isinstance(value, pa.Scalar) else value]))
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCK_FIELDS.replace(",", "\n").split("\n")])
            turn += 1

    given = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return given.mapInArrow(run, BLOCK_FIELDS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (links that hold the pair, all documents) and best (whether no id of A has more with that b)."""
    pairs = blocks.select(F.inline(F.arrays_zip("a", "b", "n"))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    # no more rows for a b than A has ids
    return pairs.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b")))


RESULT = (
    "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _sums(block: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of a block, with the sums over their links."""
    different = counts.num_rows
    at = np.asarray(counts["place"], np.int64)
    n, best = np.zeros(different, np.int64), np.zeros(different, np.int64)
    n[at], best[at] = np.asarray(counts["n"]), np.asarray(counts["best"]).astype(np.int64)
    row = {name: block[name][0] for name in block.column_names}
    places = np.frombuffer(row["links"].as_buffer(), np.uint16 if different <= 1 << 16 else np.uint32)
    ends = np.concatenate([[0], np.cumsum(np.asarray(row["n_links"].values))])

    def added(of: np.ndarray) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(of[places])])[ends]
        return pa.array(np.diff(upto), pa.int64())

    return pa.table(
        {
            "id": row["doc_id"].values,
            "n_a": row["n_a"].values,
            "n_b": row["n_b"].values,
            "n_groups": row["n_groups"].values,
            "n_links": row["n_links"].values,
            "n_best": added(best),
            "count_sum": added(n),
            "groups_sha256": row["groups_sha256"].values,
        }
    )


def align_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_tokenizer: str = BYTE_TOKENIZER,
    piece_model: str = PIECE_MODEL,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(df.sparkSession, "alignment")
    a, b = read_file(byte_tokenizer), read_file(piece_model)
    blocks = scratch(aligned_blocks(df, id_col, text_col, a, b, piece_bytes), "blocks")
    totals = scratch(pair_counts(blocks), "totals")
    pairs = blocks.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("a", "b")).alias("place", "p"))
    pairs = pairs.select("home", "place", "p.a", "p.b").join(totals, ["a", "b"]).select("home", "place", "n", "best")
    docs = blocks.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    found = docs.groupBy("block").cogroup(pairs.groupBy("home")).applyInArrow(_sums, RESULT)
    return found.withColumnRenamed("id", id_col)


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
