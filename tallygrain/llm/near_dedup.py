"""Near-duplicate documents: circulant MinHash, banding, exact verification.

A document's set are the distinct shingles of ``WIDTH`` lower-cased words (a
shorter text is one shingle). Two permutations make the whole signature: the
first scatters the shingles over the universe; coordinate ``k`` is the least
value of the second, applied to the scattered values shifted circularly by
``k``. Signatures are cut into bands; texts that agree in a band meet in its
bucket. Every link is confirmed on the full sets.

Texts with equal sets are one class, so exact copies cost nothing. In a bucket
each class is compared with the bucket's smallest (a star). Where that leaves
a bucket in several components, the pairs between components follow: in small
buckets pair by pair, in large ones block against block with one matrix product
per pair of blocks, which yields links and no pairs. So no link between texts
that meet in a bucket is lost. With 24 bands of 5, texts of similarity 0.85
fail to meet once in a million.

A null or empty text has an empty set and is linked with nothing. Repeated
rows are copies; rows of one id with different texts are linked each by its
own. Rows without an id stand alone: no component, kept. Texts of any length are
taken whole, and a tie between ids cannot matter, as a component takes its
smallest. An empty table gives an empty result; other columns are not read, and
``drop_near_duplicates`` hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, among, byte_texts, fresh, slices, table
from tallygrain.llm.registry import query
from tallygrain.operators import ordered, splitters

WIDTH = 5
PERCENT = 85
BANDS, BAND_ROWS = 24, 5
SMALL_BUCKET = 32
# of written tables: narrow rows, and rows with a set or signature
ROWS_A_FILE, SETS_A_FILE = 100_000, 10_000
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The set of a text: sorted 64-bit hashes of its shingles."""
    words = text.translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    mixed = np.full(n, span, np.uint64)
    for i in range(span):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    mixed ^= mixed >> np.uint64(30)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def signature(values: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash over the universe of 32-bit numbers; both permutations are invertible mixes."""
    scattered = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    scattered *= np.uint32(0x85EBCA6B)
    scattered ^= scattered >> np.uint32(13)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 2**32 - 1, np.uint32)
    for at in range(0, len(scattered), 2048):
        x = scattered[None, at : at + 2048] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit number for each band of the signature."""
    parts = signature(values, bands * rows).reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = (keys ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def signed(df: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """id, n, 128 bits of the set, and band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = [shingles(t) for t in byte_texts(batch.column("_text"))]
            raw = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
            keys = [band_keys(s, bands, rows) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            columns = [
                batch.column("_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(halves[:, 0]),
                pa.array(halves[:, 1]),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "hi", "lo", "bands"])

    given = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return given.mapInArrow(run, "id long, n long, hi long, lo long, bands array<bigint>")


def full_sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and set (packed 64-bit numbers) of the documents in ``wanted``, a row for each different set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            raw = [shingles(t).tobytes() for t in byte_texts(batch.column("_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(raw, pa.binary())], ["id", "set"])

    given = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = among(given, wanted.select(F.col("id").alias("_id")), "_id").mapInArrow(run, "id long, set binary")
    return found.groupBy("id", F.xxhash64("set")).agg(F.any_value("set").alias("set")).select("id", "set")


def alike(a: Column | str, b: Column | str, percent: int = PERCENT) -> Column:
    """Whether sets of these sizes can be linked at all."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each left set with each right set."""
    sets = left + right
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, cells, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[cells] > 1
    rows, cells = rows[shared], np.unique(cells[shared], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(cells, kind="stable")
    rows, cells = rows[order], cells[order]
    step = 4096
    for first in range(0, int(cells[-1]) + 1 if len(cells) else 0, step):
        a, b = np.searchsorted(cells, [first, first + step])
        grid = np.zeros((len(sets), step), np.float32)
        grid[rows[a:b], cells[a:b] - first] = 1
        out += np.rint(grid[: len(left)] @ grid[len(left) :].T).astype(np.int64)
    return out


def block_links(ids: list[int], comps: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links between components that hold the two blocks together: no more than there are rows."""
    left = [i for i, s in enumerate(sides) if s != 1]
    right = [i for i, s in enumerate(sides) if s != 0]
    sizes = np.array(list(map(len, sets)))
    both = overlaps([sets[i] for i in left], [sets[i] for i in right])
    whole = sizes[left][:, None] + sizes[right][None, :] - both
    apart = np.array(comps)[left][:, None] != np.array(comps)[right][None, :]
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in np.argwhere((100 * both >= percent * whole) & apart).tolist():
        x, y = find(comps[left[i]]), find(comps[right[j]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[left[i]], ids[right[j]]))
    return out


def large_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of large buckets, found block against block."""
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("long")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cut = members.withColumn("blocks", blocks).withColumn("own", own)
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
        "id",
        "comp",
    )

    def run(group: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        given = [group.column(c).to_pylist() for c in ("id", "comp", "side")]
        links = block_links(*given, raw, percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return keyed.join(sets, "id").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and comp (smallest id reachable) of every id in links (a, b): least neighbours, then leaps, until nothing changes."""
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    parts = 2 * links.count() / ROWS_A_FILE
    edges = scratch(links.select("a", "b").unionByName(back).filter("a != b").distinct(), "edges", parts)
    first = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
    labels = scratch(first.select("id", F.least("id", "m").alias("comp")), "labels", parts)
    while True:
        of_b = labels.select(F.col("id").alias("b"), "comp")
        around = edges.join(of_b, "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        near = labels.join(around, "id").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("hop"))
        leap = labels.select(F.col("id").alias("hop"), F.col("comp").alias("far"))
        moved = near.join(leap, "hop").select("id", "old", F.least("hop", "far").alias("comp"))
        moved = scratch(moved, "labels", parts)
        labels = moved.select("id", "comp")
        if moved.filter("old != comp").isEmpty():
            return labels


def near_links(
    df: DataFrame, classes: DataFrame, scratch: Scratch, id_col: str, text_col: str, percent: int, bands: int, small: int
) -> DataFrame:
    """id and comp of the linked classes."""
    keyed = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    keyed = keyed.select("id", "n", F.xxhash64("band", "key").alias("bucket"))
    heads = keyed.groupBy("bucket").agg(
        F.min("id").alias("head"), F.max("id").alias("last"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")
    )
    most = classes.count()
    heads = scratch(heads.filter("head != last").drop("last"), "heads", most * bands / 2 / ROWS_A_FILE)
    members = scratch(keyed.join(heads, "bucket"), "members", most * bands / ROWS_A_FILE)
    met = members.count()
    wanted = scratch(members.select("id").distinct(), "wanted", met / ROWS_A_FILE)
    sets = scratch(full_sets(df, wanted, id_col, text_col), "sets", wanted.count() / SETS_A_FILE)

    star = members.filter("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch(confirmed(star, sets, percent), "links", met / SETS_A_FILE)
    found = components(links, scratch)

    labelled = members.filter("m > 2").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    labelled = scratch(labelled, "labelled", met / ROWS_A_FILE)
    still = labelled.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1")
    still = labelled.join(scratch(still.select("bucket"), "open", met / ROWS_A_FILE), "bucket")
    few = still.filter((F.col("m") <= small) & (F.col("id") != F.col("head")))
    right = few.select("bucket", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    pairs = few.join(right, "bucket").filter((F.col("id") < F.col("b")) & (F.col("comp") != F.col("comp_b")))
    pairs = pairs.filter(alike("n", "n_b", percent)).select(F.col("id").alias("a"), "b").distinct()
    more = confirmed(pairs, sets, percent).unionByName(large_links(still.filter(F.col("m") > small), sets, percent))
    more = scratch(more, "links")
    return found if more.isEmpty() else components(links.unionByName(more), scratch)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    small: int = SMALL_BUCKET,
) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (whether the document is its component's smallest)."""
    scratch = Scratch(df.sparkSession, "near-dedup")
    rows = scratch(signed(df, id_col, text_col, bands, band_rows), "rows")
    classes = rows.filter("n > 0 and id is not null").groupBy("hi", "lo")
    classes = classes.agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"))
    size = rows.count()
    classes = scratch(classes, "classes", size / SETS_A_FILE)
    found = near_links(df, classes, scratch, id_col, text_col, percent, bands, small)
    named = classes.join(found, "id", "left").select("hi", "lo", F.coalesce("comp", "id").alias("comp"))
    named = scratch(named, "named", size / ROWS_A_FILE)
    scratch.clear("rows", "named")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return rows.join(named, ["hi", "lo"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        comp.alias("component_id"),
        F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"),
    )


def one_row_each(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, key: str) -> DataFrame:
    """The rows with ``key``, their id, or, where ids are not unique, a number for each different (id, text).

    Numbers are in the order of ids; of rows with equal id and text one stays.
    Rows without an id are kept and have no number.
    """
    keyed = df.withColumn(key, F.col(id_col).cast("long"))
    if keyed.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
        return keyed
    a, b, n, row = (fresh(keyed, name) for name in ("_a", "_b", "_n", "_row"))
    keyed = keyed.withColumns({a: F.xxhash64(text_col), b: F.xxhash64(F.lit(1), text_col)})
    texts = scratch(keyed.filter(F.col(key).isNotNull()).groupBy(key, a, b).agg(F.count(F.lit(1)).alias("times")), "texts")
    blocks = splitters.with_block(texts, [key, a, b], "_block_no")
    places = ordered.position(blocks, [], [key, a, b], "place", [F.col("_block_no")]).select(key, a, b, "times", "place")
    places = scratch(places.withColumnsRenamed({"times": n, "place": row}), "places")
    joined = keyed.join(places, [key, a, b], "left").drop(key, a, b).withColumnRenamed(row, key)
    single = joined.filter(F.coalesce(F.col(n), F.lit(1)) == 1).drop(n)
    # copies of a row come down to one in every task, before they are shuffled
    several = joined.filter(F.col(n) > 1).groupBy(key).agg(F.any_value(F.struct(*df.columns)).alias(row))
    return single.unionByName(several.select(F.col(f"{row}.*"), key))


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows, with all their columns, without those that are near-duplicates of a document with a smaller id.

    Texts under one id are judged each by itself, in the order of a hash; of
    rows with equal id and text one stays.
    """
    scratch, key = Scratch(df.sparkSession, "near-gone"), fresh(df, "_id")
    rows = one_row_each(df, scratch, id_col, text_col, key)
    gone = near_duplicates(rows, key, text_col, percent).filter(~F.col("kept")).select(key).distinct()
    return among(rows, scratch(gone, "gone"), key, keep=False).drop(key)


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
