"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs that form a piece, and merges
the pair with the best score (the leftmost of equals) until none is left.
Characters without a piece become byte pieces. No piece reaches over the start
of a run of spaces, so a text falls into units that are encoded once for each
batch: short units of one length side by side in arrays, a merge of each per
round; long ones with a heap. In every batch some texts are also encoded by
the sentencepiece library, and a difference stops the job.

Null and empty texts have no ids and decode to the empty text. Texts of any
length are encoded whole, repeated rows each by itself; an empty table gives an
empty result. Columns named like a result are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from tallygrain.llm.common import expand, int_lists, slices, table
from tallygrain.llm.registry import query

MODEL = "piece_bpe_32k.model"
CHECK_EVERY = 64  # every 64th text of a batch goes through the library too
PIECE_BYTES = 2 << 20
SHORT = 24  # symbols of a unit that is merged in arrays
SPACE = "▁"
NEVER = np.int32(2**31 - 1)


def read_model(name_or_path: str = MODEL) -> bytes:
    """The model file, by path or by its name among the public tokenizers."""
    if "/" not in name_or_path:
        import public_tokenizers

        name_or_path = public_tokenizers.path(name_or_path)
    with open(name_or_path, "rb") as f:
        return f.read()


class Codec:
    """A merge-type vocabulary with byte pieces and plain text (no normalisation but the space mark)."""

    def __init__(self, model: bytes) -> None:
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = model_pb2.ModelProto.SentencePiece
        if (
            trainer.model_type != model_pb2.TrainerSpec.BPE
            or rules.precompiled_charsmap
            or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces
            or trainer.treat_whitespace_as_suffix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        ):
            raise ValueError("only BPE models without normalisation, user pieces or unused pieces")
        self.model, self.prefix = model, rules.add_dummy_prefix
        self.size = len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = np.array([i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE], np.int32)
        if len(self.byte_ids) != 256:
            raise ValueError("byte pieces are needed")
        joined = {c for p in normal if len(p) > 1 for c in p}
        if joined - normal.keys() or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece has a character that is no piece, or a space mark after other characters")
        self.breaks = "\n" not in joined
        # characters: their piece, or the vocabulary size and the code point
        self.of_char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        order = sorted(normal.values(), key=lambda i: -proto.pieces[i].score)
        self.rank = np.full(self.size, NEVER, np.int32)
        place, last = -1, None
        for i in order:  # equal scores have equal ranks
            place, last = place + (proto.pieces[i].score != last), proto.pieces[i].score
            self.rank[i] = place
        pairs = sorted(
            (normal[p[:k]] * self.size + normal[p[k:]], i)
            for p, i in normal.items()
            for k in range(1, len(p))
            if p[:k] in normal and p[k:] in normal
        )
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.merged = np.array([i for _, i in pairs] + [0], np.int32)

    @cached_property
    def library(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)

    @cached_property
    def pair_map(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.merged.tolist()))

    def join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank NEVER where the pair is no piece."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        at = np.searchsorted(self.keys, key)
        piece = self.merged[at]
        return piece, np.where(self.keys[at] == key, self.rank[piece], NEVER)

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The agenda as a heap of (rank, place, left, right) over linked symbols."""
        n, size = len(symbols), self.size
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and symbols[i] < size and symbols[j] < size:
                piece = self.pair_map.get(symbols[i] * size + symbols[j])
                if piece is not None:
                    heapq.heappush(agenda, (int(self.rank[piece]), i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self.pair_map[left * size + right], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s >= 0]

    def merge_short(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of one length, a row each: merged symbols (left-aligned) and how many."""
        rows, width = symbols.shape
        out, counts = np.zeros_like(symbols), np.full(rows, width, np.int32)
        index = np.arange(rows)
        pieces, ranks = self.join(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        pieces, ranks = pieces.reshape(rows, width - 1), ranks.reshape(rows, width - 1)
        while len(index):
            width = symbols.shape[1]
            if width > 1:
                own = np.arange(len(index))
                best = ranks.argmin(axis=1)
                go = ranks[own, best] != NEVER
            else:
                go = np.zeros(len(index), bool)
            done = index[~go]
            out[done, :width], counts[done] = symbols[~go], width
            if not go.any():
                break
            index, symbols, best, pieces, ranks = index[go], symbols[go], best[go], pieces[go], ranks[go]
            own, places = np.arange(len(index)), np.arange(width - 1)
            new = pieces[own, best]
            symbols = np.take_along_axis(symbols, places + (places > best[:, None]), axis=1)
            symbols[own, best] = new
            if width == 2:
                ranks = pieces = np.zeros((len(index), 0), np.int32)
                continue
            gone = places[:-1] + (places[:-1] >= best[:, None])
            pieces, ranks = np.take_along_axis(pieces, gone, axis=1), np.take_along_axis(ranks, gone, axis=1)
            left = np.flatnonzero(best > 0)
            b = best[left]
            pieces[left, b - 1], ranks[left, b - 1] = self.join(symbols[left, b - 1], symbols[left, b])
            right = np.flatnonzero(best < width - 2)
            b = best[right]
            pieces[right, b], ranks[right, b] = self.join(symbols[right, b], symbols[right, b + 1])
        return out, counts

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the units one after the other, each unit's first place and number of ids."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        symbols = self.of_char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        kept, owners, totals = [], [], np.zeros(len(units), np.int64)
        for width in range(1, SHORT + 1):
            own = np.flatnonzero(sizes == width)
            if len(own):
                out, counts = self.merge_short(symbols[begin[own][:, None] + np.arange(width)])
                kept.append(out[np.arange(width) < counts[:, None]])
                owners.append(np.repeat(own, counts))
                totals[own] = counts
        for u in np.flatnonzero(sizes > SHORT).tolist():
            ids = self.merge_long(symbols[begin[u] : begin[u] + sizes[u]].tolist())
            kept.append(np.array(ids, np.int32))
            owners.append(np.full(len(ids), u))
            totals[u] = len(ids)
        if not kept:
            return np.zeros(0, np.int32), totals, totals
        flat, owner = np.concatenate(kept), np.concatenate(owners)
        flat, owner = flat[order := np.argsort(owner, kind="stable")], owner[order]
        # characters without a piece: the bytes of their UTF-8 form
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):
            raw = [chr(c).encode() for c in (flat[odd] - self.size).tolist()]
            times = np.ones(len(flat), np.int64)
            times[odd] = list(map(len, raw))
            flat, owner = np.repeat(flat, times), np.repeat(owner, times)
            flat[flat >= self.size] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            totals = np.bincount(owner, minlength=len(units))
        return flat, np.concatenate([[0], np.cumsum(totals)[:-1]]), totals

    def units(self, texts: pa.Array) -> pa.ListArray:
        """Each text cut before runs of spaces and before line feeds, spaces as space marks."""
        marked = pc.replace_substring(pc.replace_substring(texts, SPACE, " "), " ", " " + SPACE)
        if self.prefix:
            marked = pc.binary_join_element_wise(SPACE, marked, "")
        else:  # the first unit of a text that starts with a space would be empty
            marked = pc.replace_substring_regex(marked, "^ ", "")
        if self.breaks:
            marked = pc.replace_substring(marked, "\n", " \n")
        split = f"{SPACE} {SPACE}"
        while pc.any(pc.match_substring(marked, split)).as_py():
            marked = pc.replace_substring(marked, split, SPACE + SPACE)
        return pc.split_pattern(marked, " ")

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = self.units(texts)
        bounds = np.asarray(lists.offsets, np.int64)
        units = lists.flatten().dictionary_encode()
        if not len(units):
            return pa.array([[]] * len(texts), pa.list_(pa.int32()))
        flat, begin, counts = self.encode_units(units.dictionary.to_pylist())
        which = np.asarray(units.indices)
        times = counts[which]
        ends = np.cumsum(times)
        ids = flat[expand(times, begin[which])]
        ends = np.concatenate([[0], ends])[bounds - bounds[0]]
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        if empty.any():  # a text of nothing has no prefix either
            sizes = np.diff(ends)
            ids = ids[np.repeat(~empty, sizes)]
            ends = np.concatenate([[0], np.cumsum(np.where(empty, 0, sizes))])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids, by the library."""
        return pa.array(self.library.decode(int_lists(ids), num_threads=1), pa.string())

    def check(self, texts: pa.Array, ids: pa.ListArray, every: int) -> None:
        at = pa.array(range(0, len(texts), every))
        given = [t or "" for t in texts.take(at).to_pylist()]
        if self.library.encode(given, num_threads=1) != int_lists(ids.take(at)):
            raise RuntimeError("encoding differs from the sentencepiece library")


@cache
def codec_of(model: bytes) -> Codec:
    return Codec(model)


def encode_decode(
    df: DataFrame,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
    model: bytes | None = None,
    check_every: int = CHECK_EVERY,
) -> DataFrame:
    """The rows with all their columns, the ids of their texts, and the texts decoded from the ids."""
    proto = read_model() if model is None else model
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(proto)
        for batch in slices(batches, text_col, PIECE_BYTES):
            texts = batch.column(text_col)
            ids = codec.encode(texts)
            if check_every:
                codec.check(texts, ids, check_every)
            names = [*kept, ids_col, decoded_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids, codec.decode(ids)], names)

    given = df.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(run, f"{schema}, `{ids_col}` array<int>, `{decoded_col}` string")


def digests(coded: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Count and SHA-256 of the ids (decimal, joined by commas) and SHA-256 of the decoded text, in place of both."""
    return coded.withColumns(
        {
            "n_tokens": F.size(ids_col).cast("long"),
            "ids_sha256": F.sha2(F.concat_ws(",", F.col(ids_col).cast("array<string>")), 256),
            "decoded_sha256": F.sha2(decoded_col, 256),
        }
    ).drop(ids_col, decoded_col)


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
