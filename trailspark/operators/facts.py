"""Fact-table maintenance: idempotent stores, dimensions, evidence grade, bounded reads, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("chain", "tx_hash", "dedup_key")


def first_write(rows: DataFrame, order: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """One row a key: the first by ``order``; the row travels whole as the smallest of structs.

    An aggregate of structs combines before the shuffle, which a window would not.
    """
    rest = [c for c in rows.columns if c not in key and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return rows.groupBy(*key).agg(row).select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def new_rows(batch: DataFrame, stored: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of a batch whose key the store lacks."""
    return batch.join(stored.select(*key), list(key), "left_anti")


def new_dimension(batch: DataFrame, stored: DataFrame, key: Sequence[str], first_by: str, attributes: Sequence[str]) -> DataFrame:
    """Dimension rows that a batch adds; null keys match null keys, attributes are the earliest."""
    made = batch.groupBy(*key).agg(*[F.min_by(a, first_by).alias(a) for a in attributes])
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    on = [made[k].eqNullSafe(old[f"_{k}"]) for k in key]
    return made.join(old, on, "left_anti")


def graded(movements: DataFrame, verified: DataFrame) -> DataFrame:
    """``movements`` with ``graded``: native always, a token only when its contract is verified.

    The registry of verified contracts is a small published list; Spark broadcasts it by its size.
    """
    known = verified.select("chain", F.lower("contract").alias("_c")).distinct().withColumn("_known", F.lit(True))
    m = movements.withColumn("_c", F.lower("contract"))
    out = m.join(known, ["chain", "_c"], "left")
    grade = (F.col("asset_kind") == "native") | (F.col("contract").isNotNull() & F.coalesce("_known", F.lit(False)))
    return out.withColumn("graded", grade).drop("_c", "_known")


def backfill(stored: DataFrame, found: DataFrame, key: Sequence[str], column: str = "gas_price") -> DataFrame:
    """``stored`` with nulls of ``column`` filled from ``found`` once, and ``changed``."""
    new = found.where(F.col(column).isNotNull()).groupBy(*key).agg(F.min(column).alias("_new"))
    out = stored.join(new, list(key), "left")
    return out.withColumn("changed", F.col(column).isNull() & F.col("_new").isNotNull()).withColumn(column, F.coalesce(column, "_new")).drop("_new")


def sides(movements: DataFrame) -> DataFrame:
    """Each movement once for either end: address, side (in or out), other end."""
    into = movements.withColumns({"address": F.col("to_addr"), "side": F.lit("in"), "other": F.col("from_addr")})
    out = movements.withColumns({"address": F.col("from_addr"), "side": F.lit("out"), "other": F.col("to_addr")})
    return into.where("address is not null").unionByName(out.where("address is not null"))


def directional_read(movements: DataFrame, direction: str, n: int | None = None) -> DataFrame:
    """What an address sees: backward its receipts from the newest, forward its sends from the earliest.

    ``n`` keeps the first rows of each address; Spark cuts them before and after the shuffle.
    """
    address = "to_addr" if direction == "backward" else "from_addr"
    when = F.desc("ts") if direction == "backward" else F.asc("ts")
    w = Window.partitionBy(address).orderBy(when, "tx_hash", "idx")
    out = movements.where(F.col(address).isNotNull()).withColumn("address", F.col(address)).withColumn("place", F.row_number().over(w))
    return out if n is None else out.where(F.col("place") <= n)


def comparable_window(movements: DataFrame, n: int = 500) -> DataFrame:
    """Both sides of every address from the newest, at most ``n`` rows each: what detectors compare."""
    w = Window.partitionBy("address", "side").orderBy(F.desc("ts"), "tx_hash", "idx", "dedup_key")
    return sides(movements).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def tx_halves(movements: DataFrame, transactions: DataFrame) -> DataFrame:
    """All movements of the given transactions."""
    return movements.join(transactions.select("chain", "tx_hash").distinct(), ["chain", "tx_hash"], "left_semi")


#: Shape rules of a movement: name and what breaks it.
MOVEMENT_RULES = {
    "input_ends": "kind = 'utxo_input' AND (from_addr IS NULL OR to_addr IS NOT NULL)",
    "output_ends": "kind = 'utxo_output' AND (to_addr IS NULL OR from_addr IS NOT NULL)",
    "account_ends": "kind NOT IN ('utxo_input', 'utxo_output') AND (from_addr IS NULL OR to_addr IS NULL)",
    "amount": "amount_str IS NULL OR NOT amount_str RLIKE '^(0|[1-9][0-9]*)$'",
    "self_move": "from_addr = to_addr",
}


def broken_rules(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``rows`` with ``broken``: names of the rules a row breaks; null conditions do not break."""
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()])))


def digest(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON with sorted keys; our own digest, for content addresses."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def identity_conflicts(rows: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Keys for which feeds disagree on the amount: rows, distinct amounts, feeds."""
    out = rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.count_distinct("amount_str").alias("n_amounts"), F.count_distinct("provider").alias("n_feeds"))
    return out.where("n_amounts > 1")
