"""Inverted index: token to sorted, delta-coded postings, stored so that a search reads its terms only.

A token's ids are sorted and cut into chunks of bounded size, each a row with
its first id and the differences from it; so a token that stands in a third of
all rows is many rows. Tables are cut into blocks of ids first, and a token's
ids are gathered block by block: pairs of token and id are shuffled once, after
each task has gathered its own, and no group is larger than a block. Chunks are
put in the order of their tokens and stored in parts of about equal size
(``operators/splitters.py``), a folder each, with a small directory of the
first and last token of every part. A term, or a prefix of one, opens the few
parts that can hold it.

Searches are answered in batches. The postings of all their terms are merged by
id: a row is found if it is in the lists of all terms (``&``) or of any (``|``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrain.operators import splitters
from tallygrain.session import work_folder, written

CHUNK = 4096  # ids of a row
IDS_A_BLOCK = 1 << 17  # a token's ids of one block are gathered at a time
ROWS_A_PART = 1 << 15  # a file each: a few MB, as most rows hold one id
MOST_TERMS = 62  # of one search
FIELDS = "token string, first long, gaps array<bigint>, part int"


class Wanted(NamedTuple):
    search: str
    number: int  # of the term in its search
    stem: str
    prefix: bool


class Index(NamedTuple):
    """A stored index: its folder, and (part, first token, last token) of every part."""

    spark: SparkSession
    path: str
    parts: list[tuple[int, str, str]]

    def parts_for(self, terms: Sequence[Wanted]) -> list[int]:
        """The parts that can hold one of the terms."""

        def holds(low: str, high: str, t: Wanted) -> bool:
            return low[: len(t.stem)] <= t.stem <= high if t.prefix else low <= t.stem <= high

        return [p for p, low, high in self.parts if any(holds(low, high, t) for t in terms)]

    def postings(self, terms: Sequence[Wanted]) -> DataFrame:
        """search, number and id of the rows in the lists of the terms, from the parts that can hold them."""
        opened = [f"{self.path}/part={p}" for p in self.parts_for(terms)]
        if not opened:
            return self.spark.createDataFrame([], "search string, number int, id long")
        rows = self.spark.read.schema(FIELDS).option("basePath", self.path).parquet(*opened)
        hit = lambda t: F.startswith("token", F.lit(t.stem)) if t.prefix else F.col("token") == t.stem
        asked = F.array_compact(
            F.array(*[F.when(hit(t), F.struct(F.lit(t.search).alias("search"), F.lit(t.number).alias("number"))) for t in terms])
        )
        rows = rows.filter(reduce(or_, map(hit, terms))).select(F.inline(asked), "first", "gaps")
        return rows.select("search", "number", (F.explode("gaps")).alias("gap"), "first").select(
            "search", "number", (F.col("first") + F.col("gap")).alias("id")
        )

    def search(self, searches: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
        """search and id of what each search finds.

        A search is its terms and ``&`` (all) or ``|`` (any); a term that ends
        in ``*`` stands for all tokens that begin with it. An empty term is in
        no row.
        """
        terms = [
            Wanted(name, i, t.rstrip("*"), t.endswith("*"))
            for name, (given, _) in searches.items()
            for i, t in enumerate(dict.fromkeys(given))
        ]
        most = {name: len(dict.fromkeys(given)) for name, (given, _) in searches.items()}
        if any(n > MOST_TERMS for n in most.values()):
            raise ValueError(f"more than {MOST_TERMS} terms in a search")
        found = self.postings([t for t in terms if t.stem])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("number"))
        merged = found.groupBy("search", "id").agg(F.bit_or(bit).alias("terms"))
        full = F.lit(False)
        for name, (_, mode) in searches.items():
            enough = F.lit(True) if mode == "|" else F.col("terms") == (1 << most[name]) - 1
            full = F.when(F.col("search") == name, enough).otherwise(full)
        return merged.filter(full).select("search", "id")


def build(df: DataFrame, id_col: str, tokens: Column, label: str = "index", chunk: int = CHUNK) -> Index:
    """Store an index of ``tokens`` (an array of texts; null and empty ones are left out) under ``id_col``, a whole number."""
    spark = df.sparkSession
    listed = df.select(F.col(id_col).cast("long").alias("id"), tokens.alias("tokens")).filter("id is not null")
    # blocks are found for rows, which are few, and not for each of their tokens
    blocked = splitters.with_block(listed, ["id"], "block", IDS_A_BLOCK)
    pairs = blocked.select("id", "block", F.explode(F.array_distinct("tokens")).alias("token")).filter("token != ''")
    lists = pairs.groupBy("token", "block").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    starts = F.sequence(F.lit(1), F.size("ids"), F.lit(chunk))
    chunks = lists.select("token", F.explode(F.transform(starts, lambda at: F.slice("ids", at, chunk))).alias("ids"))
    chunks = chunks.select("token", F.get("ids", F.lit(0)).alias("first"), "ids")
    rows = chunks.select("token", "first", F.transform("ids", lambda x: x - F.col("first")).alias("gaps"))
    rows = splitters.with_block(written(rows, f"{label}-rows"), ["token", "first"], "part", ROWS_A_PART)
    path = work_folder(spark, label)
    rows.repartition("part").sortWithinPartitions("part", "token", "first").write.partitionBy("part").parquet(path)
    # a row a part, and parts are bounded in number
    stored = spark.read.schema(FIELDS).parquet(path)
    bounds = stored.groupBy("part").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    return Index(spark, path, sorted((r["part"], r["low"], r["high"]) for r in bounds.collect()))


# an index is built once for a table and used by all later searches of the session
_BUILT: dict[tuple[str, ...], Index] = {}


def index_of(spark: SparkSession, table: str, name: str, make) -> Index:
    """The index ``name`` of a table that does not change, made by ``make()`` at its first use."""
    key = (spark.sparkContext.applicationId, table, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def letter_tokens(column: str, digits: bool = True) -> Column:
    """The lower-case words of a text: runs of letters, and digits if asked for."""
    return F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+" if digits else r"[^\p{L}]+")


def quoted_tokens(column: str) -> Column:
    """The values of a JSON text array written with single quotes."""
    return F.from_json(F.replace(F.col(column), F.lit("'"), F.lit('"')), "array<string>")
