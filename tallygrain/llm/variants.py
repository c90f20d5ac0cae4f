"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word is a vector of its letter counts. A replaced letter takes one count down
and another up (L1 distance two), an inserted letter takes one up (distance
one). So near words of one length lie within one down and one up of each other,
near words of neighbouring lengths within one up of the shorter.

Words of a length are cut by a k-d tree into leaves. The trees are fitted to a
bounded sample of the words (``SAMPLE``); every word is then placed in its own
leaf and sent, as a query, to all leaves whose box its edits can reach, in the
tree of its length and in that of the next. Leaves with more words than fit are
dealt into cells by a hash, and the queries of a cell into several groups, so
that a group is bounded whatever the words are. In a group a second tree over
its words prunes the search, and what is left is verified letter by letter. A
pair is found once: between cells of one length the smaller cell asks.

Groups return one row a word (how many near words, the best of them), never
pairs; Spark adds them up. Chains of forms are followed by pointer jumping,
each step a join.

A null or empty text has no words; rows without an id are hashed as if their id
were empty; repeated rows count again; texts and words of any length are taken
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, byte_texts, slices, table
from tallygrain.llm.registry import query

LETTERS = "A-Za-zÀ-ÿ"
DIMS = 26 + 64  # a to z, U+00C0 to U+00FF
MIN_LETTERS, MIN_COUNT, FORM_FACTOR = 7, 2, 10
DELETE_EVERY = 31
SAMPLE = 100_000  # words the trees are fitted to
LEAF_WORDS, LEAST_SAMPLES = 4096, 16
CELL_WORDS, GROUP_QUERIES = 4 * LEAF_WORDS, 1 << 16
NODE_WORDS = 48  # words of a node that is not split in a group
HELD_WORDS = 200_000  # different words a task holds before it hands them on
ROWS_A_FILE = 200_000

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


# --- words


def noisy_words(df: DataFrame, id_col: str, text_col: str, least: int, every: int | None) -> DataFrame:
    """word and n, in parts: runs of letters with A-Z lower-cased; every so many lose a letter, by their hash."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )
            held.clear()
            return found

        for batch in slices(batches, "_text"):
            for doc, text in zip(batch.column("_id").to_pylist(), byte_texts(batch.column("_text"))):
                seed = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word in runs.findall(text.translate(LOWERED).decode()):
                    if every:
                        h = zlib.crc32(word.encode(), seed)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    held[word] = held.get(word, 0) + 1
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    given = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return given.mapInArrow(run, "word string, n long")


# --- vectors and trees


def codes(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.where(points < 0xC0, points - ord("a"), points - 0xC0 + 26).astype(np.uint8)


def counts(letters: np.ndarray) -> np.ndarray:
    """Letter counts, a row each."""
    n = len(letters)
    cells = np.arange(n)[:, None] * DIMS + letters
    return np.bincount(cells.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


class Node(NamedTuple):
    """A split (``dim``: up to ``at`` to the left) with the box's bounds there, or a leaf (``dim`` -1, number ``at``)."""

    dim: int
    at: int
    low: int
    high: int
    left: int
    right: int


HIGHEST = 1 << 30


def best_split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The letter and count that halve the vectors best; None if all are equal."""
    best, chosen = 0, None
    order = np.sort(vectors, axis=0)
    n = len(vectors)
    middle = order[n // 2]
    for at in (middle - 1, middle):
        left = (vectors <= at).sum(axis=0)
        even = np.minimum(left, n - left)
        dim = int(even.argmax())
        if even[dim] > best:
            best, chosen = int(even[dim]), (dim, int(at[dim]))
    if chosen is None:  # one vector may hold nearly all places of the middle
        spread = np.flatnonzero(order[0] < order[-1])
        chosen = (int(spread[0]), int(order[0][spread[0]])) if len(spread) else None
    return chosen


def build(vectors: np.ndarray, most: int) -> list[Node]:
    """A k-d tree whose leaves hold at most ``most`` of the vectors (or equal ones only)."""
    nodes: list[Node] = []
    leaves = 0

    def grow(rows: np.ndarray, low: dict[int, int], high: dict[int, int]) -> int:
        nonlocal leaves
        split = best_split(vectors[rows]) if len(rows) > most else None
        place = len(nodes)
        if split is None:
            nodes.append(Node(-1, leaves, 0, 0, 0, 0))
            leaves += 1
            return place
        dim, at = split
        nodes.append(Node(dim, at, 0, 0, 0, 0))
        side = vectors[rows, dim] <= at
        left = grow(rows[side], low, high | {dim: at})
        right = grow(rows[~side], low | {dim: at + 1}, high)
        nodes[place] = Node(dim, at, low.get(dim, 0), high.get(dim, HIGHEST), left, right)
        return place

    grow(np.arange(len(vectors)), {}, {})
    return nodes


def visits(nodes: list[Node], vectors: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves with the vectors that reach their box by at most ``up`` added and ``down`` removed letters."""
    zero = np.zeros(len(vectors), np.int32)
    stack = [(0, np.arange(len(vectors)), zero, zero)]
    while stack:
        place, rows, more, less = stack.pop()
        if not len(rows):
            continue
        node = nodes[place]
        if node.dim < 0:
            yield node.at, rows
            continue
        v = vectors[rows, node.dim]
        # distance to the box in this letter, before and after the cut
        right = more + np.maximum(node.at + 1 - v, 0) - np.maximum(node.low - v, 0)
        left = less + np.maximum(v - node.at, 0) - np.maximum(v - node.high, 0)
        r, q = right <= up, left <= down
        stack.append((node.right, rows[r], right[r], less[r]))
        stack.append((node.left, rows[q], more[q], left[q]))


def fit_trees(words: list[str], share: float) -> dict[int, list[Node]]:
    """A tree for each length in a sample that is ``share`` of all words."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    most = max(LEAST_SAMPLES, int(LEAF_WORDS * share))
    return {length: build(counts(codes(own)), most) for length, own in by_length.items()}


ONE_LEAF = [Node(-1, 0, 0, 0, 0, 0)]


# --- searching a group


def parities(vectors: np.ndarray) -> np.ndarray:
    """Two 64-bit masks of the odd counts: an edit changes two bits at most."""
    odd = np.zeros((len(vectors), 128), np.uint8)
    odd[:, :DIMS] = vectors & 1
    return np.packbits(odd, axis=1).view(np.uint64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or by one that ``b`` has more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    same = np.ones((len(a), 1), bool)
    front = np.logical_and.accumulate(np.hstack([same, a == b[:, :n]]), axis=1).sum(axis=1) - 1
    back = np.logical_and.accumulate(np.hstack([same, (a == b[:, 1:])[:, ::-1]]), axis=1).sum(axis=1) - 1
    return front + back >= n


def search(targets: np.ndarray, queries: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, target) of words one edit apart, given as letters; ``own`` for the words of one list, each pair once."""
    nothing = np.zeros(0, np.int64)
    if not len(targets) or not len(queries):
        return nothing, nothing
    same = targets.shape[1] == queries.shape[1]
    tv, qv = counts(targets), counts(queries)
    tp, qp = parities(tv), parities(qv)
    nodes = build(tv, NODE_WORDS)
    members = dict(visits(nodes, tv, 0, 0))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for leaf, asking in visits(nodes, qv, 1, 1 if same else 0):
        held = members[leaf]
        step = max(1, (1 << 20) // len(held))
        for at in range(0, len(asking), step):
            some = asking[at : at + step]
            apart = np.bitwise_count(qp[some, None, 0] ^ tp[None, held, 0]) + np.bitwise_count(qp[some, None, 1] ^ tp[None, held, 1])
            i, j = np.nonzero(apart <= 2)
            i, j = some[i], held[j]
            if own:
                i, j = i[i < j], j[i < j]
            # the distance first, then the order of the letters
            near = np.abs(qv[i] - tv[j]).sum(axis=1) == (2 if same else 1)
            i, j = i[near], j[near]
            good = one_edit(queries[i], targets[j])
            found.append((i[good], j[good]))
    if not found:
        return nothing, nothing
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def best_of(words: pa.Array, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Per word of the pairs (either side): how many near words, and the one with the largest n, the first of equals."""
    both, other = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.empty(len(words), np.int64)
    rank[np.asarray(pc.sort_indices(words))] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], both))
    both, other = both[order], other[order]
    first = np.flatnonzero(np.diff(both, prepend=-1))
    near = np.diff(np.append(first, len(both)))
    return pa.table(
        {
            "word": words.take(pa.array(both[first])),
            "near": pa.array(near, pa.int64()),
            "best_n": pa.array(n[other[first]], pa.int64()),
            "best": words.take(pa.array(other[first])),
        }
    )


TARGET, SAME, SHORTER = 0, 1, 2


def search_group(group: pa.Table) -> pa.Table:
    """One row a word that has near words: targets among themselves, and with the queries sent to them."""
    words = group.column("word").combine_chunks()
    n, role = np.asarray(group.column("n")), np.asarray(group.column("role"))
    texts = words.to_pylist()
    of = {r: np.flatnonzero(role == r) for r in (TARGET, SAME, SHORTER)}
    letters = {r: codes([texts[i] for i in rows]) if len(rows) else np.zeros((0, 0), np.uint8) for r, rows in of.items()}
    pairs = []
    # copies of the targets in further groups do not meet each other again
    if len(of[TARGET]) and group.column("part")[0].as_py() == 0:
        i, j = search(letters[TARGET], letters[TARGET], own=True)
        pairs.append((of[TARGET][i], of[TARGET][j]))
    for r in (SAME, SHORTER):
        i, j = search(letters[TARGET], letters[r])
        pairs.append((of[r][i], of[TARGET][j]))
    return best_of(words, n, np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))


# --- the operator


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lengths in a batch of words, with the rows and vectors of each."""
    texts = batch.column("word").to_pylist()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, counts(codes([texts[i] for i in rows]))


def own_leaves(words: DataFrame, trees: dict[int, list[Node]]) -> DataFrame:
    """length, leaf and number of words of each leaf, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, vectors in _by_length(batch):
                found = [(leaf, len(rows)) for leaf, rows in visits(trees.get(length, ONE_LEAF), vectors, 0, 0)]
                columns = [pa.array([length] * len(found), pa.int64()), *[pa.array(c, pa.int64()) for c in zip(*found)]]
                yield pa.RecordBatch.from_arrays(columns, ["length", "leaf", "held"])

    return words.select("word").mapInArrow(run, "length long, leaf long, held long")


def route(words: DataFrame, trees: dict[int, list[Node]], cells: dict[tuple[int, int], int]) -> DataFrame:
    """Every word in its cell, and as a query in all cells it can have near words in. ``cells``: of leaves with more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.fromiter((zlib.crc32(w.encode()) for w in batch.column("word").to_pylist()), np.int64, batch.num_rows)
            out: list[tuple[int, int, int, int, np.ndarray]] = []
            for length, rows, vectors in _by_length(batch):
                leaf_of = np.zeros(len(rows), np.int64)
                cell_of = np.zeros(len(rows), np.int64)
                for leaf, here in visits(trees.get(length, ONE_LEAF), vectors, 0, 0):
                    many = cells.get((length, leaf), 1)
                    leaf_of[here], cell_of[here] = leaf, hashes[rows[here]] % many
                    for cell in range(many):
                        out.append((length, leaf, cell, TARGET, rows[here[cell_of[here] == cell]]))
                for leaf, here in visits(trees.get(length, ONE_LEAF), vectors, 1, 1):
                    for cell in range(cells.get((length, leaf), 1)):
                        before = (leaf_of[here] < leaf) | ((leaf_of[here] == leaf) & (cell_of[here] < cell))
                        out.append((length, leaf, cell, SAME, rows[here[before]]))
                for leaf, here in visits(trees.get(length + 1, ONE_LEAF), vectors, 1, 0):
                    for cell in range(cells.get((length + 1, leaf), 1)):
                        out.append((length + 1, leaf, cell, SHORTER, rows[here]))
            out = [x for x in out if len(x[4])]
            sizes = [len(x[4]) for x in out]
            keys = [pa.array(np.repeat(np.array([x[k] for x in out], np.int64), sizes)) for k in range(4)]
            taken = pa.array(np.concatenate([x[4] for x in out]) if out else np.zeros(0, np.int64))
            columns = [*keys, batch.column("word").take(taken), batch.column("n").take(taken)]
            yield pa.RecordBatch.from_arrays(columns, ["length", "leaf", "cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "length long, leaf long, cell long, role long, word string, n long")


def near_words(words: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """word, near, best_n and best of the words that have near words."""
    every = max(1, -(-total // SAMPLE))
    drawn = words.filter(F.pmod(F.xxhash64("word"), F.lit(every)) == 0).select("word")
    trees = fit_trees([r["word"] for r in drawn.collect()], 1 / every)  # about SAMPLE words
    leaves = own_leaves(words, trees).groupBy("length", "leaf").agg(F.sum("held").alias("held"))
    # a row for each leaf that holds too much
    large = leaves.filter(F.col("held") > CELL_WORDS).collect()
    cells = {(r["length"], r["leaf"]): -(-r["held"] // LEAF_WORDS) for r in large}
    routed = scratch(route(words, trees, cells), "routed")
    groups = routed.filter(F.col("role") > 0).groupBy("length", "leaf", "cell").count()
    # cells whose queries fill more than one group
    parts = groups.select("length", "leaf", "cell", F.ceil(F.col("count") / GROUP_QUERIES).alias("parts")).filter("parts > 1")
    parts = scratch(parts, "parts", 1)
    whole = F.coalesce("parts", F.lit(1).cast("long"))
    own = F.sequence(F.lit(0).cast("long"), whole - 1)
    asked = F.array(F.pmod(F.xxhash64("word"), whole))
    dealt = routed.join(parts, ["length", "leaf", "cell"], "left")
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("role") == TARGET, own).otherwise(asked))).drop("parts")
    found = dealt.groupBy("length", "leaf", "cell", "part").applyInArrow(search_group, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b"))
    return found.select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def follow(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root: the end of each chain of (word, form). Chains end, as n grows along them."""
    jumps = scratch(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("far"))
        ahead = scratch(jumps.join(onward, "root", "left").select("word", "root", "far"), "jumps")
        jumps = ahead.select("word", F.coalesce("far", "root").alias("root"))
        if ahead.filter("far is not null").isEmpty():
            return jumps


def spelling_variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = MIN_LETTERS,
    delete_every: int | None = None,
) -> DataFrame:
    """Per word of at least ``least`` letters that occurs twice or more: word, form, root, n, n_near, form_n.

    ``delete_every`` takes a letter from runs whose hash it divides, to plant
    variants whose form is known.
    """
    scratch = Scratch(df.sparkSession, "variants")
    counted = noisy_words(df, id_col, text_col, least, delete_every).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch(counted.filter(F.col("n") >= MIN_COUNT), "words")
    near = near_words(words, words.count(), scratch)
    joined = words.join(near, "word", "left")
    formed = F.col("best_n") >= FORM_FACTOR * F.col("n")
    known = scratch(
        joined.select(
            "word",
            F.when(formed, F.col("best")).alias("form"),
            "n",
            F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "known",
    )
    roots = follow(known.filter("form is not null"), scratch)
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), delete_every=DELETE_EVERY)
