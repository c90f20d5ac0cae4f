"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors, scaled to length 1, are projected on random normal directions, shifted
and cut into cells of some width; the cells of a few directions name a bucket,
in each of some tables. A query visits its own bucket and those with a few cells
changed by one, in the order in which they are likely to hold near vectors: the
sum of squared distances to the cell borders it crosses, ranked by its expected
value. The candidates of all tables are ranked again by their exact cosine.

Which setting (directions, tables, probes, width) is used is measured: on the
true neighbours of ``MEASURED`` queries, and on ``DRAWN`` vectors drawn by a
hash, that show how many comparisons a query would make. Of the settings that
find ``RECALL`` of the neighbours the cheapest is taken. A table holds every
vector once, so with one table no pair is compared twice, and comparing all
pairs is the yardstick: where no setting is cheaper, it is what is done.

Equal vectors are one class with its smallest ids, as many as can be asked for;
so copies cost nothing. Buckets are cut into blocks of bounded size, queries of
a bucket as well, and block meets block: no row stands for a pair. A query that
finds fewer than ``k`` is compared with all vectors, block by block.

Vectors that are null, zero, of another dimension than most, or hold null or
non-finite components take no part, nor do rows without an id. Repeated rows
count once; a query's own id is no neighbour. Ties go to the smaller id. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, table
from tallygrain.llm.registry import query

K = 5
TABLES = 12
PROBES = 32
WIDTH = 1.75
SEED = 7
# what settings are tried: tables and probes in each, and cell widths
TRIED_TABLES, TRIED_PROBES, TRIED_WIDTHS = (1, 2, 3, 4), (16, 64, 256), (1.75, 2.0, 2.5)
DRAWN = 2048  # vectors that stand for all where comparisons are counted
VISIT = 16  # what a visited block costs a query, in comparisons
RECALL = 0.95  # of the measured queries' neighbours, above the 0.9 that all should find
MEASURED = 256
BLOCK = 256
HELD_QUERIES = 100_000  # whose best a task holds before it hands them on
HEAVY_KEYS = 1 << 20  # buckets with several blocks that are sent to every task at most


def functions_for(rows: int) -> int:
    """Most directions of a table: buckets grow in number with the rows."""
    return max(2, round(0.45 * math.log2(max(rows, 2))))


def probe_sets(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Which cell borders to cross, as ranks among the 2 * ``functions`` borders by distance, likeliest first."""
    m = functions
    rank = np.arange(1, 2 * m + 1)
    near = rank * (rank + 1) / (4 * (m + 1) * (m + 2))
    back = 2 * m + 1 - rank
    cost = np.where(rank <= m, near, 1 - back / (m + 1) + back * (back + 1) / (4 * (m + 1) * (m + 2)))
    found: list[tuple[int, ...]] = [()]
    agenda = [(float(cost[0]), (0,))]
    while agenda and len(found) < probes:
        total, chosen = heapq.heappop(agenda)
        # ranks r and 2m - 1 - r are the two borders of one cell
        if all(2 * m - 1 - r not in chosen for r in chosen):
            found.append(chosen)
        last = chosen[-1] + 1
        if last < 2 * m:
            heapq.heappush(agenda, (total - cost[last - 1] + cost[last], chosen[:-1] + (last,)))
            heapq.heappush(agenda, (total + cost[last], (*chosen, last)))
    return found


class Tables:
    """The directions of all tables, drawn from a seed."""

    def __init__(self, dimension: int, functions: int, tables: int = TABLES, width: float = WIDTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(size=(tables, dimension, functions)) / width
        self.shifts = rng.uniform(size=(tables, functions))

    def __len__(self) -> int:
        return len(self.shifts)

    def places(self, t: int, units: np.ndarray) -> np.ndarray:
        return units @ self.directions[t] + self.shifts[t]

    @staticmethod
    def keys(t: int, cells: np.ndarray) -> np.ndarray:
        key = np.full(len(cells), t + 1, np.uint64)
        for column in cells.astype(np.int64).view(np.uint64).T:
            key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def own(self, units: np.ndarray) -> np.ndarray:
        """[table, vector] key of the vector's own bucket."""
        return np.stack([self.keys(t, np.floor(self.places(t, units))) for t in range(len(self))])

    def probed(self, units: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
        """[table and probe, vector] keys of the buckets to visit."""
        rows, out = np.arange(len(units)), []
        for t in range(len(self)):
            places = self.places(t, units)
            cells = np.floor(places)
            m = cells.shape[1]
            border = np.argsort(np.concatenate([places - cells, 1 - (places - cells)], axis=1), axis=1, kind="stable")
            for chosen in sets:
                moved = cells.copy()
                for rank in chosen:
                    at = border[:, rank]
                    moved[rows, at % m] += np.where(at < m, -1, 1)
                out.append(self.keys(t, moved))
        return np.stack(out)


def vectors_of(column: pa.Array, dtype: str, dimension: int) -> np.ndarray:
    """Packed vectors as a matrix of doubles."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(-1, dimension).astype(np.float64)


def units_of(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def classes(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, int]:
    """cid, ids (the smallest k + 1) and packed vec of each different usable vector; their dimension."""
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("id is not null and v is not null")
    dims = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = dims[0]["d"] if dims else 0
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = given.filter((F.size("v") == dimension) & fine & F.exists("v", lambda x: x != 0)).distinct()
    by_id = W.partitionBy("v").orderBy("id")
    few = usable.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("cid"), "ids", "v"), dimension


def packed(df: DataFrame, dtype: str, columns: str, names: list[str]) -> DataFrame:
    """``v`` as bytes in column ``vec``; the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, dtype).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], [*names, "vec"])

    return df.mapInArrow(run, f"{columns}, vec binary")


def blocked(rows: DataFrame, scratch: Scratch, members: list[str], hashed: str, block: int) -> DataFrame:
    """Rows (key, members ..) as blocks: key and list of at most about ``block`` members, in no order that matters."""
    sizes = rows.groupBy("key").count().filter(F.col("count") > block)
    heavy = scratch(sizes.select("key", F.ceil(F.col("count") / block).alias("blocks")), "heavy")
    # a heavy bucket has over BLOCK rows, so these are few; beyond the bound Spark shuffles
    joined = rows.join(F.broadcast(heavy) if heavy.count() <= HEAVY_KEYS else heavy, "key", "left")
    number = F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64(hashed), F.col("blocks")))
    return joined.groupBy("key", number.alias("block")).agg(F.collect_list(F.struct(*members)).alias("rows"))


def best_ids(q: np.ndarray, x: np.ndarray, qids: list[int], ids: list[list[int]], k: int) -> Iterator[list[tuple]]:
    """(-score, id) of each query's best ``k`` among the classes ``x`` with their ``ids``."""
    rough = units_of(q) @ units_of(x).T
    most = min(k + 1, len(x))
    edge = np.partition(rough, len(x) - most, axis=1)[:, len(x) - most] - 1e-9
    at, col = np.nonzero(rough >= edge[:, None])
    a, b = q[at], x[col]
    exact = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    # rows come in order, so those of a query are a slice
    ends = np.searchsorted(at, np.arange(len(qids) + 1)).tolist()
    exact, col = exact.tolist(), col.tolist()
    for j, row in enumerate(qids):
        yield sorted((-exact[i], v) for i in range(ends[j], ends[j + 1]) for v in ids[col[i]] if v != row)[:k]


def first_of(hits: list[tuple], k: int) -> list[tuple]:
    """The best ``k`` of (-score, id), each id once."""
    out, seen = [], set()
    for hit in sorted(hits):
        if hit[1] not in seen:
            seen.add(hit[1])
            out.append(hit)
            if len(out) == k:
                break
    return out


def best_of(queries: DataFrame, data: DataFrame, dtype: str, dimension: int, k: int) -> DataFrame:
    """query_id, vec_id and exact score of the best that each task finds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # what a query has found in all blocks of this task so far
        best: dict[int, list[tuple]] = {}

        def rows() -> pa.RecordBatch:
            out = [(row, v, -s) for row, hits in best.items() for s, v in hits]
            best.clear()
            kinds = (pa.int64(), pa.int64(), pa.float64())
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                asked, held = batch.column("asked")[i].values, batch.column("held")[i].values
                q, x = (vectors_of(part.field("vec"), dtype, dimension) for part in (asked, held))
                qids, ids = asked.field("qid").to_pylist(), held.field("ids").to_pylist()
                for row, hits in zip(qids, best_ids(q, x, qids, ids, k)):
                    best[row] = first_of(best[row] + hits, k) if row in best else first_of(hits, k)
            if len(best) >= HELD_QUERIES:
                yield rows()
        yield rows()

    asked = queries.select("key", F.col("rows").alias("asked"))
    met = asked.join(data.select("key", F.col("rows").alias("held")), "key").select("asked", "held")
    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recalled(q: np.ndarray, near: np.ndarray, hashes: Tables, sets: list[tuple[int, ...]]) -> float:
    """Share of the pairs (query, neighbour), row by row, that meet in a probed bucket."""
    own, probed = hashes.own(near), hashes.probed(q, sets)
    met = np.zeros(len(q), bool)
    for t in range(len(hashes)):
        met |= (probed[t * len(sets) : (t + 1) * len(sets)] == own[t]).any(axis=0)
    return float(met.mean())


def measured(asked: DataFrame, data: DataFrame, dtype: str, dimension: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of the pairs (query, true neighbour) of ``MEASURED`` queries drawn by a hash, found among all vectors."""
    drawn = asked.orderBy(F.xxhash64("qid", "vec"), "qid").limit(MEASURED).collect()
    if not drawn:
        return np.zeros((0, dimension)), np.zeros((0, dimension))
    qids = [r["qid"] for r in drawn]
    raw = pa.array([bytes(r["vec"]) for r in drawn], pa.binary())
    q = vectors_of(raw, dtype, dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x, ids = vectors_of(part.column("vec"), dtype, dimension), part.column("ids").to_pylist()
                out = [(j, v, -s) for j, hits in enumerate(best_ids(q, x, qids, ids, k)) for s, v in hits]
                kinds = (pa.int64(), pa.int64(), pa.float64())
                columns = [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    best = ranked(data.select("ids", "vec").mapInArrow(run, "query_id long, vec_id long, score double"), k)
    pairs = [(r["query_id"], r["vec_id"]) for r in best.select("query_id", "vec_id").collect()]
    wanted = sorted({v for _, v in pairs})
    held = data.withColumn("id", F.explode("ids")).filter(F.col("id").isin(wanted)).select("id", "vec").collect()
    # an id with several vectors stands for the first met: this is a measurement, results do not use it
    vecs = {r["id"]: bytes(r["vec"]) for r in held}
    near = vectors_of(pa.array([vecs[v] for _, v in pairs], pa.binary()), dtype, dimension)
    return units_of(q[[j for j, _ in pairs]]), units_of(near)


def directions(rows: int, q: np.ndarray, near: np.ndarray, tables: int, probes: int, width: float, seed: int) -> int:
    """The most directions, up to those for ``rows``, that keep ``RECALL`` of the measured pairs; 0 if none do."""
    for functions in range(functions_for(rows), 0, -1):
        hashes = Tables(q.shape[1], functions, tables, width, seed)
        if not len(q) or recalled(q, near, hashes, probe_sets(functions, probes)) >= RECALL:
            return functions
    return 0


class Setting(NamedTuple):
    functions: int
    tables: int
    probes: int
    width: float


def visited(q: np.ndarray, drawn: np.ndarray, hashes: Tables, sets: list[tuple[int, ...]]) -> float:
    """Comparisons a query makes for each vector there is, counted on the drawn ones."""
    own, probed = hashes.own(drawn), hashes.probed(q, sets)
    hits = 0
    for t in range(len(hashes)):
        keys, times = np.unique(own[t], return_counts=True)
        asked = probed[t * len(sets) : (t + 1) * len(sets)].ravel()
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hits += int(times[at][keys[at] == asked].sum())
    return hits / max(1, len(q) * len(drawn))


def cheapest(rows: int, q: np.ndarray, near: np.ndarray, drawn: np.ndarray, seed: int) -> Setting | None:
    """The setting with the fewest comparisons that finds ``RECALL`` of the measured pairs; None if all pairs are cheaper.

    A visit costs something too: as many comparisons as ``VISIT``, for every
    bucket, or for every block where a query meets all vectors.
    """
    if not len(q):
        return None
    best, least = None, rows + VISIT * math.ceil(rows / BLOCK)
    asked = np.unique(q, axis=0)
    for functions in range(2, functions_for(rows) + 1):
        for tables, probes, width in itertools.product(TRIED_TABLES, TRIED_PROBES, TRIED_WIDTHS):
            sets = probe_sets(functions, probes)
            # all changes by one of so few directions are fewer than these probes
            if len(sets) < probes:
                continue
            hashes = Tables(q.shape[1], functions, tables, width, seed)
            share = visited(asked, drawn, hashes, sets)
            cost = share * rows + VISIT * tables * len(sets) * max(1, math.ceil(share * rows / (tables * len(sets) * BLOCK)))
            if cost < least and recalled(q, near, hashes, sets) >= RECALL:
                best, least = Setting(functions, tables, probes, width), cost
    return best


def nearest(
    df: DataFrame,
    queries: Column | str,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int | None = None,
    probes: int = PROBES,
    width: float = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """For the rows that ``queries`` picks, their ``k`` nearest others found: query_id, rank, vec_id, score (cosine).

    ``tables``, ``probes`` and ``width`` hold if ``tables`` is given (then only
    the directions are measured); else they are chosen.
    """
    scratch = Scratch(df.sparkSession, "nearest")
    kind = df.schema[vec_col].dataType.elementType.simpleString()
    dtype = "<f4" if kind == "float" else "<f8"
    found, dimension = classes(df, id_col, vec_col, k)
    data = scratch(packed(found, dtype, "cid long, ids array<bigint>", ["cid", "ids"]), "classes")
    rows = data.count()
    known = F.col("v")
    asking = df.filter(queries).select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).alias("v")).distinct()
    fine = F.forall(known, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asking = asking.filter(F.col("qid").isNotNull() & known.isNotNull() & (F.size("v") == dimension))
    asking = asking.filter(fine & F.exists(known, lambda x: x != 0))
    asked = scratch(packed(asking, dtype, "qid long", ["qid"]), "asked")
    pairs = measured(asked, data, dtype, dimension, k) if rows else (np.zeros((0, max(dimension, 1))),) * 2
    if tables is None:
        drawn = data.orderBy(F.xxhash64("cid", "vec"), "cid").limit(DRAWN).select("vec").collect() if rows else []
        drawn = vectors_of(pa.array([bytes(r["vec"]) for r in drawn], pa.binary()), dtype, max(dimension, 1))
        chosen = cheapest(rows, *pairs, units_of(drawn), seed)
        functions, tables, probes, width = chosen or Setting(0, 1, 0, width)
    else:
        functions = directions(rows, *pairs, tables, probes, width, seed)
    hashes = Tables(max(dimension, 1), functions, tables, width, seed)
    sets = probe_sets(functions, probes) if functions else []

    def keyed(names: list[str], visit: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    units = units_of(vectors_of(part.column("vec"), dtype, dimension))
                    keys = hashes.probed(units, sets) if visit else hashes.own(units)
                    for row in keys:
                        yield pa.RecordBatch.from_arrays([pa.array(row), *(part.column(n) for n in names)], ["key", *names])

        return run

    if functions:
        index = data.mapInArrow(keyed(["cid", "ids", "vec"], False), "key long, cid long, ids array<bigint>, vec binary")
        visits = asked.mapInArrow(keyed(["qid", "vec"], True), "key long, qid long, vec binary")
        met = best_of(
            blocked(visits, scratch, ["qid", "vec"], "qid", BLOCK),
            blocked(index, scratch, ["ids", "vec"], "cid", BLOCK),
            dtype,
            dimension,
            k,
        )
        best = scratch(ranked(met, k), "best")
        # queries that found fewer than k: against all vectors
        full = best.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("qid"))
        short = scratch(asked.join(full, "qid", "left_anti"), "short")
        if short.isEmpty():
            scratch.clear("best")
            return best.select("query_id", "rank", "vec_id", "score")
    else:
        best, short = None, asked
    blocks = max(1, -(-rows // BLOCK))
    cells = data.withColumn("key", F.pmod(F.xxhash64("cid"), F.lit(blocks)))
    cells = cells.groupBy("key").agg(F.collect_list(F.struct("ids", "vec")).alias("rows"))
    group = short.withColumn("g", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-short.count() // BLOCK)))))
    group = group.groupBy("g").agg(F.collect_list(F.struct("qid", "vec")).alias("rows"))
    group = group.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rest = ranked(best_of(group, cells, dtype, dimension, k), k)
    if best is not None:
        rest = best.join(short.select(F.col("qid").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    whole = scratch(rest, "whole")
    scratch.clear("whole")
    return whole.select("query_id", "rank", "vec_id", "score")


@query("op8_multiprobe_nearest")
def op8_multiprobe_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "pmod(vec_id, 50) = 0")
