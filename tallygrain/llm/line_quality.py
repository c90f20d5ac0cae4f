"""Quality by lines: a linear-chain conditional random field marks content and boilerplate.

Each line of a text that holds a word is described by a set of yes/no features
(packed into one integer). One of them comes from the whole corpus: whether the
line is *common*, standing in many places between different neighbours (so that
the lines of copied documents, which keep their neighbours, are not). Lines that
make up a ``COMMON_SHARE`` of all lines are no more than its inverse, so their
hashes go to every task.

A chain with two states, content and boilerplate, is fitted by maximum
likelihood to a bounded sample of labelled documents, whole texts of them. Line
states are latent: in good documents common lines are boilerplate and the others
content; in poor ones every line is free, but boilerplate lines hold at least
half of the words. Fitting and choosing the states of poor documents take turns
(hard EM), starting from what sets the lines of poor documents apart. Viterbi
decoding then labels the lines of every whole text, and the share of words on
content lines decides whether the document stays. A base rule (too few words,
too much repetition) comes first.

Null and empty texts have no words and fail the base rule. Texts of any length
are judged whole, repeated rows each by itself; ties between states go to
content; an empty table gives an empty result; other columns are not read.
Without labelled lines of both kinds the chain has no weights and calls every
line content.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Set
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.common import byte_texts, slices, table
from tallygrain.llm.registry import query
from tallygrain.operators.splitters import once
from tallygrain.session import written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_CONTENT_SHARE = 0.5
SAMPLE_DOCS = 300  # labelled documents of each kind the chain is fitted to
RUN_LINES = 64  # a sampled text is fitted in runs of so many lines
TURNS = 4  # of fitting the chain and choosing the states of poor documents
COMMON_SHARE, COMMON_LEAST = 1e-4, 5  # of all lines, and lines: what makes a line common
COMMON_APART = 0.5  # different neighbours a place of a common line
POOR_SHARE = 0.5  # of the words of a poor document that boilerplate lines hold at least

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()
DIGITS = b"0123456789"
FEATURES = 15
COMMON = 1 << 14  # the feature of common lines


class Chain(NamedTuple):
    """Weights of the field; state 0 is content, state 1 boilerplate."""

    start: np.ndarray  # [2]
    step: np.ndarray  # [from, to]
    emit: np.ndarray  # [feature, state]; the last row is the bias
    common: frozenset[int] = frozenset()  # hashes of the corpus's common lines


def flat_chain() -> Chain:
    emit = np.zeros((FEATURES + 1, 2))
    emit[-1, 0] = 1.0
    return Chain(np.zeros(2), np.zeros((2, 2)), emit)


def line_code(line: bytes, words: list[bytes], seen: bool, common: bool = False) -> int:
    """The features of one line that holds a word, one bit each."""
    n, size = len(words), len(line)
    plain = len(line.translate(None, LETTERS))
    letters = size - plain
    upper = size - len(line.translate(None, UPPER))
    symbols = size - len(line.translate(None, SYMBOLS))
    shouts = line.count(b"!")
    flags = (
        n < 4,
        n >= 12,
        symbols > 0,
        2 * symbols >= n,
        2 * upper > letters > 0,
        shouts >= 2,
        4 * shouts >= n,
        line.count(b"|") >= 2,
        n >= 4 and 2 * len(set(words)) <= n,
        seen,
        words[-1][-1:] not in (b".", b"!", b"?", b":", b'"'),
        2 * letters < size - n,
        4 * (size - len(line.translate(None, DIGITS))) > size,
        b"://" in line or b"www." in line,
        common,
    )
    return sum(1 << i for i, f in enumerate(flags) if f)


def line_hash(line: bytes) -> int:
    """The hash of a line as Spark's ``xxhash64`` has it."""
    return xxhash.xxh64_intdigest(line, 42)


def line_codes(text: bytes, common: Set[int] = frozenset()) -> tuple[list[bytes], list[int], list[int], int]:
    """All words; code and word count of each line with a word; lines equal to an earlier one."""
    words: list[bytes] = []
    codes: list[int] = []
    sizes: list[int] = []
    earlier: set[bytes] = set()
    repeated = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        seen = line in earlier
        earlier.add(line)
        repeated += seen
        words += own
        codes.append(line_code(line, own, seen, bool(common) and line_hash(line.strip()) in common))
        sizes.append(len(own))
    return words, codes, sizes, repeated


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(words) - 2 + shift] |= again
    return int(inside.sum())


def scores_of(code: int, chain: Chain) -> tuple[float, float]:
    rows = [i for i in range(FEATURES) if code >> i & 1] + [FEATURES]
    total = chain.emit[rows].sum(axis=0)
    return float(total[0]), float(total[1])


def decode(codes: list[int], chain: Chain, memo: dict[int, tuple[float, float]]) -> list[int]:
    """Viterbi: the likeliest states of a text's lines; ties go to content."""
    if not codes:
        return []
    (aa, ab), (ba, bb) = chain.step.tolist()
    a = b = None
    back = []
    for code in codes:
        own = memo.get(code)
        if own is None:
            own = memo[code] = scores_of(code, chain)
        if a is None:
            a, b = chain.start[0] + own[0], chain.start[1] + own[1]
            continue
        to_a, to_b = b + ba > a + aa, b + bb > a + ab
        a, b = (b + ba if to_a else a + aa) + own[0], (b + bb if to_b else a + ab) + own[1]
        back.append((to_a, to_b))
    state = int(b > a)
    states = [state]
    for pair in reversed(back):
        state = int(pair[state])
        states.append(state)
    return states[::-1]


def runs_of(samples: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, ...]:
    """Codes, states, whether a place is filled, whether a run is its text's first, and its text, of padded runs."""
    runs = [(i, t, c[t : t + RUN_LINES], y[t : t + RUN_LINES]) for i, (c, y) in enumerate(samples) for t in range(0, len(c), RUN_LINES)]
    longest = max(len(c) for _, _, c, _ in runs)
    codes, states = np.zeros((len(runs), longest), np.int64), np.zeros((len(runs), longest), np.int64)
    inside = np.zeros((len(runs), longest), bool)
    for r, (_, _, c, y) in enumerate(runs):
        codes[r, : len(c)], states[r, : len(c)], inside[r, : len(c)] = c, y, True
    return codes, states, inside, np.array([t == 0 for _, t, _, _ in runs]), np.array([i for i, _, _, _ in runs])


def fit_chain(
    samples: list[tuple[list[int], int | list[int]]],
    rounds: int = 120,
    rate: float = 2.0,
    decay: float = 1e-3,
    kinds: list[int] | None = None,
) -> Chain:
    """Maximum likelihood by gradient ascent; a sample's lines have the states given, or all the one given.

    The samples of a kind (their state, where all lines have one) weigh as much
    as those of the other.
    """
    kinds = [y for _, y in samples] if kinds is None else kinds
    whole = sorted((list(c), [y] * len(c) if isinstance(y, int) else list(y), k) for (c, y), k in zip(samples, kinds) if c)
    if len({s for _, y, _ in whole for s in y}) < 2:
        return flat_chain()
    codes, states, inside, first, text = runs_of([(c, y) for c, y, _ in whole])
    n, longest = codes.shape
    kind, size = np.array([k for *_, k in whole]), np.array([len(c) for c, *_ in whole])
    # each kind weighs the same, however many samples it has, and each sample, however many lines
    per_text = np.array([1.0 / max(1, len(set(kind.tolist()))) / (kind == k).sum() for k in kind])
    weight, lines = per_text[text], size[text][:, None, None]
    bits = np.concatenate([codes[..., None] >> np.arange(FEATURES) & 1, np.ones((n, longest, 1), np.int64)], axis=2)
    bits = bits * inside[..., None] * 1.0
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((FEATURES + 1, 2))
    truth = np.eye(2)[states]  # [run, line, state]
    pairs = np.eye(4)[states[:, :-1] * 2 + states[:, 1:]].reshape(n, longest - 1, 2, 2)
    for _ in range(rounds):
        local = bits @ emit
        ahead = np.empty((n, longest, 2))
        behind = np.zeros((n, longest, 2))
        ahead[:, 0] = start * first[:, None] + local[:, 0]
        for t in range(1, longest):
            reach = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + local[:, t]
            ahead[:, t] = np.where(inside[:, t, None], reach, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            reach = np.logaddexp.reduce(step + (local[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(inside[:, t + 1, None], reach, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        share = np.exp(ahead + behind - total[:, None, None]) * inside[..., None]
        gap = (truth * inside[..., None] - share) * weight[:, None, None]
        emit = emit + rate * (np.einsum("ntf,nts->fs", bits, gap / lines) - decay * emit)
        start = start + rate * (gap[first, 0].sum(axis=0) - decay * start)
        if longest > 1:
            both = np.exp(
                ahead[:, :-1, :, None] + step + (local[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
            )
            gap2 = (pairs - both) * inside[:, 1:, None, None] * (weight[:, None, None, None] / lines[..., None])
            step = step + rate * (gap2.sum(axis=(0, 1)) - decay * step)
    return Chain(start, step, emit)


def marginals(codes: list[int], chain: Chain) -> np.ndarray:
    """Log odds of boilerplate over content of each line of a text, given all its lines."""
    local = np.array([scores_of(c, chain) for c in codes])
    ahead, behind = local.copy(), np.zeros_like(local)
    ahead[0] += chain.start
    for t in range(1, len(codes)):
        ahead[t] += np.logaddexp.reduce(ahead[t - 1][:, None] + chain.step, axis=0)
    for t in range(len(codes) - 2, -1, -1):
        behind[t] = np.logaddexp.reduce(chain.step + local[t + 1] + behind[t + 1], axis=1)
    both = ahead + behind
    return both[:, 1] - both[:, 0]


def poor_states(odds: np.ndarray, sizes: list[int], share: float) -> list[int]:
    """Boilerplate where the odds say so, and further lines in their order, until they hold the share of the words."""
    size = np.array(sizes)
    order = np.argsort(-odds, kind="stable")
    before = np.cumsum(size[order]) - size[order]
    states = (odds > 0).astype(int)
    states[order[before < share * size.sum()]] = 1
    return states.tolist()


def fit_latent(samples: list[tuple[list[int], list[int], int]], turns: int = TURNS, share: float = POOR_SHARE) -> Chain:
    """A chain for samples of (codes, words a line, whether the document is poor), line states unknown."""
    samples = sorted((list(c), list(n), int(y)) for c, n, y in samples if c)
    if len({y for *_, y in samples}) < 2:
        return flat_chain()
    # how much likelier a kind of line is in poor documents, each document counting once
    tallies: tuple[Counter, Counter] = (Counter(), Counter())
    for codes, _, poor in samples:
        for code in codes:
            tallies[poor][code] += 1 / len(codes)
    docs = [sum(y == k for *_, y in samples) for k in (0, 1)]
    odds = {c: math.log((tallies[1][c] + 0.5) / (docs[1] + 1) / ((tallies[0][c] + 0.5) / (docs[0] + 1))) for c in {*tallies[0], *tallies[1]}}
    good = [(c, [int(x & COMMON > 0) for x in c]) for c, _, y in samples if not y]
    poor = [(c, n) for c, n, y in samples if y]
    kinds = [0] * len(good) + [1] * len(poor)
    found = [poor_states(np.array([odds[x] + (x & COMMON > 0) for x in c]), n, share) for c, n in poor]
    chain = flat_chain()
    for _ in range(turns):
        chain = fit_chain(good + [(c, y) for (c, _), y in zip(poor, found)], kinds=kinds)
        again = [poor_states(marginals(c, chain), n, share) for c, n in poor]
        if again == found:
            break
        found = again
    return chain


def common_lines(
    docs: DataFrame,
    text_col: str = "text",
    share: float = COMMON_SHARE,
    least: int = COMMON_LEAST,
    apart: float = COMMON_APART,
) -> frozenset[int]:
    """Hashes of the lines that stand in many places, mostly between different neighbours.

    A line counts if its places are at least ``share`` of all lines, so there
    are at most ``1 / share``.
    """
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))

    def places(lines: Column) -> Column:
        near = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
        return F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(near(i - 1), near(i + 1)).alias("near")))

    rows = docs.select(F.inline(once(F.filter(trimmed, lambda x: x != ""), places)))
    met = written(rows.groupBy("line", "near").agg(F.count(F.lit(1)).alias("n")), "lines-met")
    every = met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lines = met.groupBy("line").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("near"))
    wanted = (F.col("n") >= max(least, math.ceil(share * every))) & (F.col("near") >= apart * F.col("n"))
    # no more than 1 / share rows
    return frozenset(r["line"] & (1 << 64) - 1 for r in lines.filter(wanted).select("line").collect())


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Chain:
    """Find the common lines of all documents, and fit a chain to at most ``sample_docs`` good and as many poor ones.

    The sample is chosen by a hash of the id; its texts are taken whole. Label 0
    is poor, 1 good; other labels are left out.
    """
    common = common_lines(docs, text_col)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).dropna().distinct()
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("_y") == value).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [line_codes(t, common)[1:3] for t in byte_texts(batch.column("_text"))]
            columns = [pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("_y")], ["codes", "sizes", "y"])

    # the sample has at most 2 * sample_docs ids: small enough to send to every task
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).dropna()
    sample = given.join(F.broadcast(picked), "_id").select("_text", F.col("_y").cast("int").alias("_y"))
    rows = sample.mapInArrow(code, "codes array<int>, sizes array<int>, y int").collect()
    return fit_latent([(r["codes"], r["sizes"], 1 - r["y"]) for r in rows])._replace(common=common)


def judge_lines(
    df: DataFrame,
    chain: Chain,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_content_share: float = MIN_CONTENT_SHARE,
) -> DataFrame:
    """Per row: id, counts, base_failed, lines (state of each line with a word, 0 content), content_share, kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, tuple[float, float]] = {}
        for batch in slices(batches, "_text"):
            out: list[tuple] = []
            for text in byte_texts(batch.column("_text")):
                words, codes, sizes, dup_lines = line_codes(text, chain.common)
                n, repeats = len(words), repeated_words(words)
                failed = n < min_words or 100 * repeats > max_repeat_percent * n
                states = decode(codes, chain, memo)
                share = sum(s for s, state in zip(sizes, states) if not state) / n if n else 0.0
                joined = b"".join(words)
                out.append(
                    (
                        n,
                        len(joined.decode("utf-8", "replace")),
                        len(text) - len(text.translate(None, SYMBOLS)),
                        dup_lines,
                        repeats,
                        failed,
                        states,
                        share,
                        not failed and share >= min_content_share,
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int8()), pa.float64(), pa.bool_()]
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names)

    names = "_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed lines content_share kept".split()
    given = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = given.schema["_id"].dataType.simpleString()
    kinds = [id_type] + ["long"] * 5 + ["boolean", "array<tinyint>", "double", "boolean"]
    judged = given.mapInArrow(judge, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return judged.withColumnRenamed("_id", id_col)


@query("op2_line_quality")
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge_lines(docs, train(docs, table(spark, sf_dir, "labels")))
    return judged.withColumn("n_lines", F.size("lines")).drop("lines")
