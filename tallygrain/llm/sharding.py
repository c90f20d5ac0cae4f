"""Balanced label propagation: linked documents move to their neighbours' shards.

Every row gets a place from a hash of its id and text, and starts in the shard
``place mod shards``, so that shard counts differ by one at most. Linked rows
then move. The neighbours of a row are the rows of its link group.

A group of more than a part of a shard (there are few of those) is drawn
together first, the largest ahead: it fills whole shards as long as it can, and
what is left goes to the shard that it fits best into, or, where it fits into
none, to the roomiest ones. So a group of up to a shard's rows stays whole while
a shard has room for it, and a larger one lies in as few shards as it can.

All other groups are units and move in rounds. In a round each unit chooses the
shard that most of its rows are in (ties by a hash), and all its rows go there.
A shard that is chosen by more rows than its quota leaves passes the last units,
in the order of a hash, on to shards with places to spare; so units need no free
places to move into, they swap. Only a unit on the edge of such a run is cut,
fewer than twice the shards in all. Rounds go on while fewer units are cut. Rows
without links, which are at home anywhere, fill up what is left, so the counts
stay even (law ``rows``).

Only DataFrame operations are used. No task holds a group, a shard or the rows
of one key: groups enter as counts, and numbering goes by blocks of rows.

Rows are linked by equal texts; a null text is linked with nothing, counts no
bytes and has the checksum 0. Texts of any length are only hashed and measured.
Repeated rows are rows of their own, and their places, which tie, differ. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tallygrain.llm.common import table
from tallygrain.llm.registry import query
from tallygrain.operators import ordered
from tallygrain.session import written

SHARDS = 40
ROUNDS = 4
PIECES_OF_SHARD = 8  # a group of more than this part of a shard is placed first: fewer than 8 groups a shard
BLOCK_ROWS = 20_000  # rows numbered in one task, about
BUCKETS = 4096  # in whose order a shard grants requests
HASHES = 1 << 40


def hashed(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(HASHES))


def placed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """id, size, crc, link (null without text) and place 0, 1, .. of each row, written; and their number."""
    data = F.col(text_col).cast("binary")
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("crc"),
        F.unhex(F.sha1(data)).alias("link"),
    )
    rows = written(rows.withColumn("_h", hashed("id", "link")), "shard-rows")
    n = rows.count()
    block = F.floor(F.col("_h") / (HASHES // max(1, n // BLOCK_ROWS) + 1))
    numbered = ordered.position(rows, [], ["_h", "id", "link"], "place", [block])
    return written(numbered.withColumn("place", F.col("place") - 1).drop("_h"), "shard-places"), n


def quotas(n: int, shards: int) -> dict[int, int]:
    return {g: n // shards + (g < n % shards) for g in range(shards)}


def _drawn_together(groups: list[tuple[str, int]], places: dict[int, int]) -> list[tuple[str, int, int, int]]:
    """Runs (group, from, upto, shard) that put large groups into as few shards as can be; ``places`` are taken away."""
    runs, left = [], []
    for group, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        # whole shards first; nothing is in them yet that could not be elsewhere
        while size - at and size - at >= max(places.values()) > 0:
            shard = max(places, key=lambda g: (places[g], -g))
            runs.append((group, at, at + places[shard], shard))
            at += places[shard]
            places[shard] = 0
        if at < size:
            left.append((size - at, group, at))
    for size, group, at in sorted(left, key=lambda x: (-x[0], x[1])):
        while size:
            fits = [g for g in places if places[g] >= size]
            shard = min(fits, key=lambda g: (places[g], g)) if fits else max(places, key=lambda g: (places[g], -g))
            taken = min(size, places[shard])
            runs.append((group, at, at + taken, shard))
            places[shard] -= taken
            size, at = size - taken, at + taken
    return runs


def linked_rows(rows: DataFrame, n: int, shards: int) -> tuple[DataFrame, DataFrame, dict[int, int]]:
    """Rows that share their link with another: of large groups place and label, settled; of others place, unit and label.

    Also the places that large groups leave in each shard.
    """
    spark, places = rows.sparkSession, quotas(n, shards)
    groups = written(rows.filter("link is not null").groupBy("link").count().filter("count > 1"), "shard-groups")
    most = max(1, n // shards // PIECES_OF_SHARD)
    # fewer than PIECES_OF_SHARD groups a shard; small tables, where a part of a shard is a row, may have more
    large = groups.filter(F.col("count") > most).orderBy(F.desc("count"), "link").limit(2 * PIECES_OF_SHARD * shards)
    large = [(r["h"], r["count"]) for r in large.select(F.hex("link").alias("h"), "count").collect()]
    runs = _drawn_together(large, places)
    joined = rows.select("place", "link").join(groups, "link").withColumn("_hex", F.hex("link"))
    own = F.pmod("place", F.lit(shards)).cast("int").alias("label")
    if not runs:
        none = joined.select("place", own).filter("false")
        return none, written(joined.select("place", F.xxhash64("link").alias("unit"), own), "shard-linked"), places
    text = F.explode(F.split(F.lit(";".join(",".join(map(str, r)) for r in runs)), ";"))
    fields = F.split("r", ",")
    plan = spark.range(1).select(text.alias("r")).select(
        fields[0].alias("_hex"), *[fields[i + 1].cast("long").alias(c) for i, c in enumerate(("first", "last", "shard"))]
    )
    plan = F.broadcast(plan)  # fewer rows than large groups and shards
    names = plan.select("_hex").distinct()
    rest = joined.join(F.broadcast(names), "_hex", "left_anti")
    mine = joined.join(F.broadcast(names), "_hex", "left_semi")
    mine = ordered.position(mine, ["_hex"], ["place"], "turn", [F.floor(F.col("place") / BLOCK_ROWS)])
    inside = (F.col("first") < F.col("turn")) & (F.col("turn") <= F.col("last"))
    settled = mine.join(plan, "_hex").filter(inside).select("place", F.col("shard").cast("int").alias("label"))
    units = rest.select("place", F.xxhash64("link").alias("unit"), own)
    return written(settled, "shard-settled"), written(units, "shard-linked"), places


def _passed_on(totals: dict[int, int], places: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """Which runs (goal, from, upto, shard) of the rows that chose a goal stay or go on: fewer runs than twice the shards."""
    spare = sorted(((places[g] - totals.get(g, 0), g) for g in places if totals.get(g, 0) < places[g]), reverse=True)
    runs = []
    for goal in sorted(totals):
        upto = min(totals[goal], places[goal])
        runs.append((goal, 0, upto, goal))
        while upto < totals[goal]:
            left, shard = spare.pop(0)
            taken = min(left, totals[goal] - upto)
            runs.append((goal, upto, upto + taken, shard))
            upto += taken
            if taken < left:
                spare.insert(0, (left - taken, shard))
    return runs


def propagate(linked: DataFrame, n: int, places: dict[int, int], turn: int) -> DataFrame:
    """One round: every unit chooses the shard most of its rows are in; shards over their quota pass on their last units."""
    spark = linked.sparkSession
    held = linked.groupBy("unit", "label").agg(F.count(F.lit(1)).alias("own"))
    # ties go by the round, so that no shard is chosen by all
    chance = F.struct("own", F.xxhash64("unit", "label", F.lit(turn)).alias("taste"), "label")
    units = held.groupBy("unit").agg(F.max(chance).alias("best"), F.sum("own").alias("rows"))
    order = hashed("unit").alias("_h")
    units = written(units.select("unit", F.col("best.label").alias("goal"), "rows", order), "shard-units")
    # a row a shard
    totals = {r["goal"]: r["rows"] for r in units.groupBy("goal").agg(F.sum("rows").alias("rows")).collect()}
    runs = _passed_on(totals, places)
    if not runs:
        return linked
    text = F.explode(F.split(F.lit(";".join(",".join(map(str, r)) for r in runs)), ";"))
    fields = F.split("r", ",")
    plan = spark.range(1).select(text.alias("r")).select(
        *[fields[i].cast("long").alias(c) for i, c in enumerate(("goal", "first", "last", "shard"))]
    )
    block = F.floor(F.col("_h") / (HASHES // max(1, n // len(places) // BLOCK_ROWS) + 1))
    queue = ordered.running_total(units, ["goal"], ["_h", "unit"], F.col("rows"), "upto", [block])
    queue = queue.withColumn("begin", F.col("upto") - F.col("rows"))
    met = queue.join(F.broadcast(plan), "goal").filter((F.col("begin") < F.col("last")) & (F.col("first") < F.col("upto")))
    met = written(
        met.select("unit", "rows", (F.col("first") - F.col("begin")).alias("first"), (F.col("last") - F.col("begin")).alias("last"), "shard"),
        "shard-met",
    )
    whole = met.filter("first <= 0 and rows <= last").select("unit", F.col("shard").alias("goal"))
    # a unit on the edge of a run is dealt row by row: fewer such units than runs
    edge = met.filter("first > 0 or last < rows").select("unit", "first", "last", "shard")
    kept = linked.join(whole, "unit").select("place", "unit", F.col("goal").cast("int").alias("label"))
    cut = linked.join(F.broadcast(edge.select("unit").distinct()), "unit").select("place", "unit")
    cut = ordered.position(cut, ["unit"], ["place"], "turn", [F.floor(F.col("place") / BLOCK_ROWS)])
    cut = cut.join(F.broadcast(edge), "unit").filter((F.col("first") < F.col("turn")) & (F.col("turn") <= F.col("last")))
    cut = cut.select("place", "unit", F.col("shard").cast("int").alias("label"))
    return written(kept.unionByName(cut), "shard-linked")


def _cut(linked: DataFrame) -> int:
    """How many units more than one shard holds, each counted once a further shard."""
    held = linked.groupBy("unit").agg((F.countDistinct("label") - 1).alias("cut"))
    return held.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def balanced_shards(
    df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, size, crc, link, shard and slot (0, 1, .. in the shard)."""
    rows, n = placed(df, id_col, text_col)
    if rounds:
        settled, linked, places = linked_rows(rows, n, shards)
    else:  # every row where it starts
        settled, linked, places = None, rows.select("place").filter("false"), quotas(n, shards)
    left = _cut(linked) if rounds else 0
    for turn in range(rounds):
        # units start where places may be gone by now, so one round is needed at least
        if not left and turn:
            break
        before, kept = left, linked
        linked = propagate(linked, n, places, turn)
        left = _cut(linked)
        if left >= before and turn:
            linked = kept
            break
    if not rounds:
        linked = rows.select("place", F.pmod("place", F.lit(shards)).cast("int").alias("label"))
    else:
        linked = linked.select("place", "label").unionByName(settled)
    # a row a shard: the places left for rows without links, in a row of shards
    taken = {r["label"]: r["count"] for r in linked.groupBy("label").count().collect()}
    room = sorted((label, places_ - taken.get(label, 0)) for label, places_ in quotas(n, shards).items())
    free = rows.select("place").join(linked.select("place"), "place", "left_anti")
    cell = F.floor(F.col("place") / BLOCK_ROWS)
    free = ordered.position(free, [], ["place"], "turn", [cell])
    shard, upto = F.lit(None).cast("int"), 0
    steps = []
    for label, places in room:
        upto += places
        steps.append((upto, label))
    for end, label in reversed(steps):
        shard = F.when(F.col("turn") <= end, label).otherwise(shard)
    labels = linked.select("place", F.col("label").alias("shard")).unionByName(free.select("place", shard.alias("shard")))
    settled = written(rows.join(labels, "place"), "shard-settled")
    slots = ordered.position(settled, ["shard"], ["place"], "slot", [cell])
    return slots.select(F.col("id").alias(id_col), "size", "crc", "link", "shard", (F.col("slot") - 1).alias("slot"))


def cut_edges(shards: DataFrame) -> DataFrame:
    """One row for a result of ``balanced_shards``: edges (pairs of linked rows), and how many lie in two shards."""
    held = shards.filter("link is not null").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("m"))
    pairs = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("decimal(38,0)"))
    groups = held.groupBy("link").agg(F.sum("m").alias("n"), pairs("m").alias("kept"))
    every, kept = (F.coalesce(x, F.lit(0)).cast("decimal(38,0)") for x in (pairs("n"), F.sum("kept")))
    return groups.agg(every.alias("n_edges"), (every - kept).alias("n_cut"))


@query("op4_balanced_shards")
def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = balanced_shards(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
