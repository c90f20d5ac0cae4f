"""Document fingerprints: one-permutation MinHash, optimally densified, low-order bits packed.

A document's set are its distinct shingles of ``WIDTH`` lower-cased words (a
shorter text is one shingle). Every shingle is hashed once; the leading bits of
the hash name one of ``BINS`` bins and each bin keeps its least hash. An empty
bin asks other bins one after the other, in an order that hangs on its own
number alone, and copies the first that has a value (optimal densification: all
filled bins are equally likely, and two texts ask in the same order). Each
bin's value is mixed with the bin's number, so that copies of one value agree
by chance independently, and its ``BITS`` low-order bits are kept, a
hexadecimal digit.

Two bins of different sets agree by chance once in ``2 ** BITS``; ``likeness``
takes that out of the share of equal digits.

Only column functions are used. A row's shingles stay inside its own row, so
nothing is gathered; the neighbour of a row comes from blocks of consecutive
ids, each with a copy of the next block's first row.

A null or empty text, or one without words, has the empty fingerprint, which is
like itself (1) and like no other (0). Texts of any length are taken whole.
Rows of one id follow each other in the order of a hash of their texts, rows
without an id come first; rows with equal id and text are one class, handled
once and repeated at the end. An empty table gives an empty result; other
columns are not read by ``edits`` and kept by ``with_fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.llm.common import table
from tallygrain.llm.registry import query
from tallygrain.operators import splitters
from tallygrain.operators.splitters import once
from tallygrain.session import written

WIDTH = 5
BINS_LOG = 7
BINS = 1 << BINS_LOG
BITS = 4  # a hexadecimal digit
ASKED = 16  # bins asked by hash; the rest of the order is by rank
BLOCK_ROWS = 512
COPIES_A_ROW = 10_000

SHIFT = 64 - BINS_LOG
LOW = (1 << SHIFT) - 1
CHANCE = 2.0**-BITS


def words(text: Column) -> Column:
    plain = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "[\\x20\\x09-\\x0D]+"))


def shingle_hashes(found: Column, width: int = WIDTH) -> Column:
    """A 64-bit hash of each shingle of an array of words."""
    size = F.size(found)
    runs = F.transform(
        F.sequence(F.lit(0), size - width), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(width)])
    )
    return F.when(size >= width, runs).when(size > 0, F.array(F.xxhash64(found))).otherwise(F.array().cast("array<bigint>"))


def _marks() -> Column:
    """The largest hash of each bin: stands for an empty one."""
    half = BINS // 2
    return F.array(*[F.lit(((b - half) << SHIFT) | LOW) for b in range(BINS)])


def binned(hashes: Column) -> Column:
    """Each bin's least hash, null where the bin is empty."""

    def firsts(ordered: Column) -> Column:
        other = lambda x, i: F.shiftright(x, SHIFT) != F.shiftright(F.get(ordered, i - 1), SHIFT)
        return F.filter(ordered, lambda x, i: (i == 0) | other(x, i))

    least = once(F.sort_array(F.concat(hashes, _marks())), firsts)
    return F.transform(least, lambda x: F.when(x.bitwiseAND(F.lit(LOW)) != LOW, x))


def densified(values: Column) -> Column:
    """Empty bins take the value of the first filled bin in their own order."""

    def ask(i: Column, turn: int) -> Column:
        return F.get(values, F.pmod(F.xxhash64(i, F.lit(turn)), F.lit(BINS)).cast("int"))

    def by_rank(i: Column) -> Column:
        ranked = F.transform(values, lambda v, j: F.when(v.isNotNull(), F.struct(F.xxhash64(j, i).alias("r"), v.alias("v"))))
        return F.array_min(ranked).getField("v")

    return F.transform(values, lambda v, i: F.coalesce(v, *[ask(i, t) for t in range(ASKED)], by_rank(i)))


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """``BINS`` hexadecimal digits of a text; the empty string if it has no words."""
    found = once(words(F.coalesce(text, F.lit(""))), lambda w: shingle_hashes(w, width))

    def packed(dense: Column) -> Column:
        low = lambda v, i: F.xxhash64(v, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        digits = F.transform(dense, lambda v, i: F.substr(F.lit("0123456789abcdef"), low(v, i) + 1, F.lit(1)))
        # all bins are filled, or none
        return F.when(F.get(dense, 0).isNull(), "").otherwise(F.array_join(digits, ""))

    return once(once(binned(found), densified), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, agreement by chance taken out."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    share = (same / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows with ``out``, the fingerprint of their text."""
    return df.withColumn(out, fingerprint(F.col(text_col)))


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tie (hash of the text), text, turn and times: rows with equal id and text are at most two rows here.

    Of such rows all but the last are followed by themselves: turn 0 stands for
    them, turn 1 for the last.
    """
    given = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = given.withColumn("tie", F.xxhash64("text"))
    repeats = written(given.groupBy("id", "tie").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "print-repeats")
    single = given.select("id", "tie", "text", F.lit(1).alias("turn"), F.lit(1).cast("long").alias("times"))
    if repeats.isEmpty():
        return single
    marked = repeats.select(F.col("id").alias("_id"), F.col("tie").alias("_tie"), "n")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))
    merged = given.join(marked, on).groupBy("id", "tie").agg(F.any_value("text").alias("text"), F.any_value("n").alias("n"))
    turn = lambda i, times: F.struct(F.lit(i).alias("turn"), times.cast("long").alias("times"))
    turns = F.array(turn(0, F.col("n") - 1), turn(1, F.lit(1)))
    merged = written(merged.select("id", "tie", "text", F.inline(turns)), "print-classes")
    return single.join(marked, on, "left_anti").unionByName(merged)


def in_sequence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of rows in blocks of consecutive ids (``block``); ``guest`` rows are the first of the next block."""
    rows = splitters.with_block(_classes(df, id_col, text_col), ["id", "tie", "turn"], "_b", BLOCK_ROWS, "_head", "_last")
    own = F.struct(F.col("_b").alias("block"), F.lit(0).alias("guest"))
    before = F.when(F.col("_b") > 1, F.col("_b") - 1).otherwise(F.col("_last"))
    places = F.when(F.col("_head"), F.array(own, F.struct(before.alias("block"), F.lit(1).alias("guest")))).otherwise(F.array(own))
    return rows.select("id", "tie", "turn", "times", "text", F.inline(places))


def edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by
    the first as many (or all) of the next row's text; after the last comes the
    first.
    """
    order = W.partitionBy("block").orderBy("guest", "id", "tie", "turn")
    rows = in_sequence(df, id_col, text_col).withColumn("_next", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.coalesce("_next", F.lit("")), half))
    rows = rows.withColumn("edited", edited).select(
        "block",
        "guest",
        "id",
        "tie",
        "turn",
        "times",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
    )
    rows = rows.withColumn("_after", F.lead("fingerprint").over(order)).filter("guest = 0")
    result = [
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_after")).alias("near_next"),
    ]
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES_A_ROW))
    rows = rows.select(*result, "times", F.explode(chunks).alias("_c"))
    left = F.least(F.lit(COPIES_A_ROW).cast("long"), F.col("times") - F.col("_c") * COPIES_A_ROW)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), left)).alias("_t")).drop("_t")


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
