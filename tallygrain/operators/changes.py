"""Batches of changes applied to tables as set operations.

Each function takes the current table and a change DataFrame and returns the
new state. Changes are reduced to one row per key before they meet the table,
so a key changed a billion times joins as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrain.operators.joins import new_only, semi, split_join
from tallygrain.operators.ordered import position
from tallygrain.operators.windows import earliest_per, first_per, latest_per
from tallygrain.session import written


def append(df: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows by column name; columns the new rows lack become null."""
    return df.unionByName(new, allowMissingColumns=True)


def apply_update(df: DataFrame, changes: DataFrame, on: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Set columns for matching keys. Of several changes to a key the last in ``seq`` wins."""
    targets = [c for c in changes.columns if c not in on and c in df.columns]
    last = latest_per(changes, on, seq).select(
        *on, *[F.col(c).alias(f"_new_{c}") for c in targets], F.lit(True).alias("_hit")
    )
    joined = split_join(df, last, on, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
            for c in df.columns
        ]
    )


def apply_increment(df: DataFrame, deltas: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add the sums of the deltas of each key to ``columns``."""
    sums = deltas.groupBy(*on).agg(*[F.sum(c).alias(f"_d_{c}") for c in columns])
    joined = split_join(df, sums, on, "left")
    return joined.select(
        *[
            (F.col(c) + F.coalesce(f"_d_{c}", F.lit(0))).cast(df.schema[c].dataType).alias(c)
            if c in columns
            else F.col(c)
            for c in df.columns
        ]
    )


def apply_delete(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return new_only(df, keys, on)


def insert_if_absent(df: DataFrame, new: DataFrame, on: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Add rows whose natural key is not present; of a key's repeats in the batch the first in ``seq`` counts."""
    first = earliest_per(new, on, seq)
    return append(df, new_only(first, df, on))


def upsert(df: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replace rows with a matching key and add the others; ``batch`` holds one row per key."""
    return append(apply_delete(df, batch, on), batch)


def assign_ids(new: DataFrame, existing: DataFrame, id_column: str, key: str, hex_digits: int = 3) -> DataFrame:
    """Give new rows the ids after the highest existing one.

    Rows are numbered along the md5 of ``key``: its first digits split any
    batch into even blocks, and a task run again numbers its rows the same way.
    """
    numbered = position(
        new.withColumn("_h", F.md5(F.col(key).cast("string"))),
        [],
        ["_h", key],
        "_n",
        [F.substring("_h", 1, hex_digits)],
    )
    highest = existing.agg(F.coalesce(F.max(id_column), F.lit(0).cast("long"))).scalar()
    return numbered.withColumn(id_column, highest + F.col("_n")).drop("_h", "_n")


def assign_group_ids(
    new: DataFrame,
    existing: DataFrame,
    ranges: DataFrame,
    group: str,
    id_column: str,
    order: Sequence[str],
    blocks: Sequence[Column],
) -> DataFrame:
    """Ids from a range per group (``low`` to ``high``), going on after the group's highest used id.

    A range that is used up stops the job.
    """
    used = existing.groupBy(group).agg(F.max(id_column).alias("_used"))
    start = ranges.join(used, group, "left").select(
        group, F.greatest(F.col("low") - 1, F.coalesce("_used", F.col("low") - 1)).alias("_start"), F.col("high").alias("_high")
    )
    numbered = position(new, [group], order, "_n", blocks)
    given = F.col("_start") + F.col("_n")
    full = F.raise_error(F.concat(F.lit("id range used up: "), F.col(group).cast("string"))).cast("long")
    checked = F.when(given <= F.col("_high"), given).otherwise(full)
    return split_join(numbered, start, [group]).withColumn(id_column, checked).drop("_start", "_high", "_n")


def replace_if_version(
    df: DataFrame, changes: DataFrame, key: str, version: str, seq: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Replace documents whose version still matches; returns the new table and the rejected changes.

    The first matching change of a key raises the version, so later ones of
    the batch that expect the old version are stale too. ``seq`` tells a key's
    changes apart and holds no nulls.
    """
    targets = [c for c in changes.columns if c not in (key, version, *seq)]
    matching = semi(changes, df, [key, version])
    accepted = written(earliest_per(matching, [key], seq), "accepted")
    hits = accepted.select(key, *[F.col(c).alias(f"_new_{c}") for c in targets], F.lit(True).alias("_hit"))
    joined = df.join(hits, key, "left")
    table = joined.select(
        *[
            (F.col(c) + F.when(F.col("_hit"), 1).otherwise(0)).alias(c)
            if c == version
            else F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in targets
            else F.col(c)
            for c in df.columns
        ]
    )
    rejected = changes.join(accepted.select(key, *seq), [key, *seq], "left_anti")
    return table, rejected


def switch_default(
    df: DataFrame, new: DataFrame, key: str, flag: str, seq: Sequence[str]
) -> DataFrame:
    """Turn the flag of every method of the keys in ``new`` to N and add the new ones, the last one as Y."""
    last = latest_per(new.select(key, *seq), [key], seq).withColumn("_last", F.lit(True))
    added = new.join(last, [key, *seq], "left").withColumn(flag, F.when(F.col("_last"), "Y").otherwise("N"))
    changed = new.select(key).distinct().withColumn("_hit", F.lit(True))
    kept = split_join(df, changed, [key], "left").withColumn(flag, F.when(F.col("_hit"), "N").otherwise(F.col(flag)))
    return append(kept.drop("_hit"), added.drop("_last"))


def add_preferred(
    customers: DataFrame, addresses: DataFrame, new: DataFrame, seq: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Add addresses and make each customer's last new one the preferred address."""
    preferred = new.select("customer_id", F.col("address_id").alias("preferred_address"), *seq)
    return apply_update(customers, preferred, ["customer_id"], seq), append(addresses, new.drop(*seq))


def add_customers(tables: dict[str, DataFrame], new: DataFrame, key: str) -> dict[str, DataFrame]:
    """Customer, address, card and first logon of each new person, all under one new id."""
    people = written(assign_ids(new, tables["customers"], "customer_id", key), "people")
    rows = {
        "customers": people.select("customer_id", F.col(key).alias("name")),
        "addresses": people.select(F.col("customer_id").alias("address_id"), "customer_id", "country"),
        "cards": people.select(F.col("customer_id").alias("card_id"), "customer_id"),
        "logon": people.select("customer_id", F.col("since").alias("logon_date")),
    }
    return {name: append(tables[name], rows[name]) for name in rows}


def apply_orders(
    orders: DataFrame, items: DataFrame, inventory: DataFrame, new_orders: DataFrame, new_lines: DataFrame
) -> dict[str, DataFrame]:
    """New orders: in-stock lines are added, order totals set, stock lowered by what was added.

    A line is in stock when its (product, warehouse) has any quantity on hand
    before the batch. Out-of-stock lines are not added and not counted.
    """
    # used by every output below
    in_stock = written(semi(new_lines, inventory.filter("quantity_on_hand > 0"), ["product_id", "warehouse_id"]), "in-stock")
    totals = in_stock.groupBy("order_id").agg(F.sum("amount_cents").alias("total_cents"))
    headers = new_orders.join(totals, "order_id", "left").withColumn(
        "total_cents", F.coalesce("total_cents", F.lit(0).cast("long"))
    )
    taken = in_stock.select("product_id", "warehouse_id", (-F.col("quantity")).alias("quantity_on_hand"))
    return {
        "orders": append(orders, headers),
        "items": append(items, in_stock.select(*[c for c in items.columns if c in in_stock.columns])),
        "inventory": apply_increment(inventory, taken, ["product_id", "warehouse_id"], ["quantity_on_hand"]),
    }


def add_or_insert(df: DataFrame, deltas: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Add the deltas to the rows of their keys, or insert a row; ``change`` says ``kept``, ``updated`` or ``new``.

    Both sides are summed together, so a key with many deltas is one row per task before the shuffle.
    """
    old = df.select(*keys, column, F.lit(1).alias("_old"), F.lit(0).alias("_new"))
    new = deltas.select(*keys, column, F.lit(0).alias("_old"), F.lit(1).alias("_new"))
    both = old.unionByName(new).groupBy(*keys)
    summed = both.agg(F.sum(column).alias(column), F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    change = F.when(F.col("_old") == 0, "new").when(F.col("_new") == 0, "kept").otherwise("updated")
    return summed.withColumn("change", change).drop("_old", "_new")


def process_orders(orders: DataFrame, n: int, open_status: int, new_status: int) -> DataFrame:
    """Move the ``n`` oldest open orders of every warehouse to a processed status."""
    work = first_per(
        orders.filter(F.col("order_status") <= open_status).select("warehouse_id", "order_date", "order_id"),
        ["warehouse_id"],
        ["order_date", "order_id"],
        n,
    )
    # a short list: written, so that the orders need not be shuffled to meet it
    work = written(work, "work")
    changes = work.select("order_id", F.lit(new_status).alias("order_status"))
    return apply_update(orders, changes, ["order_id"], ["order_status"])


def bump_lines(items: DataFrame, orders: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One more piece on each picked line, its unit price on the order. A line may be picked more than once."""
    counted = picks.groupBy("order_id", "line_item_id").agg(F.count(F.lit(1)).alias("quantity"))
    priced = counted.join(items.select("order_id", "line_item_id", "unit_cents"), ["order_id", "line_item_id"])
    raised = apply_increment(items, counted, ["order_id", "line_item_id"], ["quantity"])
    added = priced.select("order_id", (F.col("quantity") * F.col("unit_cents")).alias("total_cents"))
    return raised, apply_increment(orders, added, ["order_id"], ["total_cents"])


def scale_up(tables: dict[str, DataFrame], n: int, keys: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Each table ``n`` times, its keys moved apart by copy so that joins stay valid.

    ``keys[table][column]`` is a one-value DataFrame with the step of that key:
    more than the key's highest value.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = {}
    for name, df in tables.items():
        copied = df.withColumn("_copy", copies)
        for column, step in keys[name].items():
            copied = copied.withColumn(column, F.col(column) + F.col("_copy") * step.scalar())
        out[name] = copied.drop("_copy")
    return out
