"""The ledger that the driver's star-schema tables stand for, as DataFrames and as DuckDB SQL.

Orders are transactions, their lines are movements; the id space of addresses is two fifths of
the orders, so that paths run many hops. Keys of suppliers and customers that fall on an
address label it. Every expression reads the same in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import first_write

CHAIN = "ledger"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address_count(spark: SparkSession, sf_dir: str) -> int:
    """Addresses of the ledger: two fifths of the orders (a count from file footers)."""
    return table(spark, sf_dir, "orders").count() * 2 // 5


def _address(key: Column, n: int) -> Column:
    return F.concat(F.lit("A"), (key % F.lit(n)).cast("string"))


def raw_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements as landed: several rows can share a transaction and key."""
    n = address_count(spark, sf_dir)
    # joined by the name of the transaction, so that what groups a transaction's rows later needs no shuffle of its own
    tx_hash = lambda key: F.concat(F.lit("T"), F.col(key).cast("string")).alias("tx_hash")
    lines = table(spark, sf_dir, "lineitem").select("*", tx_hash("l_orderkey")).join(table(spark, sf_dir, "orders").select(tx_hash("o_orderkey")), "tx_hash")
    amount = F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")
    tax = F.round(F.col("l_tax") * 100).cast("decimal(38,0)")
    return lines.select(
        F.lit(CHAIN).alias("chain"),
        "tx_hash",
        F.concat(F.lit("line:"), F.col("l_linenumber").cast("string")).alias("dedup_key"),
        F.col("l_linenumber").alias("idx"),
        F.lit("token").alias("kind"),
        F.col("l_returnflag").alias("asset"),
        (F.col("l_returnflag") != "R").alias("verified"),
        amount.alias("amount"),
        amount.cast("string").alias("amount_str"),
        _address(F.col("l_orderkey"), n).alias("from_addr"),
        _address(F.col("l_partkey") * 7 + F.col("l_suppkey"), n).alias("to_addr"),
        F.col("l_shipdate").alias("ts"),
        F.when(tax > 0, tax).alias("gas_price"),
        F.col("l_linestatus").alias("provider"),
        (F.col("l_quantity") * 10).cast("bigint").alias("retrieved_at"),
    )


#: Everything that orders repeated rows, so that every engine keeps the same one.
ARRIVAL = ("retrieved_at", "provider", "ts", "asset", "amount", "from_addr", "to_addr", "gas_price")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored movements: the first write of each transaction and key."""
    return first_write(raw_movements(spark, sf_dir), ARRIVAL)


def utxo_halves(spark: SparkSession, sf_dir: str, thin: int = 1) -> DataFrame:
    """Halves of unspent-output transactions: lines 1 and 2 spend, the others receive."""
    mv = movements(spark, sf_dir)
    if thin > 1:
        mv = mv.where(F.substring("tx_hash", 2, 20).cast("bigint") % thin == 0)
    spends = F.col("idx") <= 2
    return mv.select(
        "chain", "tx_hash", "dedup_key", "idx", F.when(spends, "utxo_input").otherwise("utxo_output").alias("kind"), "asset", "verified", "amount", "amount_str",
        F.when(spends, F.col("to_addr")).alias("from_addr"), F.when(~spends, F.col("to_addr")).alias("to_addr"), "ts", "gas_price",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address claims from suppliers and customers; entity is the nation and a number."""
    n = address_count(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nk"), F.lit("S").alias("t"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), F.lit("C").alias("t"))
    rows = s.unionByName(c).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("nk") == F.col("n_nationkey"))
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), by)
    return rows.select(
        F.lit(CHAIN).alias("chain"),
        _address(F.col("k") * 3, n).alias("address"),
        F.concat(F.initcap("n_name"), F.lit(" "), (F.col("k") % 5).cast("string")).alias("entity"),
        pick(["vasp", "vasp", "mixer", "sanctioned", "infrastructure"], (F.col("k") % 5).cast("int")).alias("category"),
        pick(["deposit", "hot", "unknown"], (F.col("k") % 3).cast("int")).alias("role"),
        ((F.col("k") % 9 + 1) / 10).alias("confidence"),
        pick(["active", "active", "pending", "retired"], (F.col("k") % 4).cast("int")).alias("status"),
        pick(["official", "community", "proof", "heuristic"], (F.floor(F.col("k") / 2) % 4).cast("int")).alias("method"),
        F.concat("t", (F.col("k") % 7).cast("string")).alias("source"),
        F.date_add(F.lit("2019-01-01").cast("date"), (F.col("k") % 2000).cast("int")).alias("source_date"),
    ).dropDuplicates(["chain", "address", "source", "entity", "category", "role", "confidence", "status", "method", "source_date"])


#: The same views as DuckDB common table expressions.
SQL = """
cnt AS (SELECT count(*) * 2 // 5 AS n FROM orders),
raw AS (
  SELECT 'ledger' AS chain, concat('T', l_orderkey) AS tx_hash, concat('line:', l_linenumber) AS dedup_key, l_linenumber AS idx, 'token' AS kind,
         l_returnflag AS asset, l_returnflag <> 'R' AS verified, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount,
         concat('A', o_orderkey % n) AS from_addr, concat('A', (l_partkey * 7 + l_suppkey) % n) AS to_addr, l_shipdate AS ts,
         CASE WHEN round(l_tax * 100) > 0 THEN CAST(round(l_tax * 100) AS BIGINT) END AS gas_price, l_linestatus AS provider,
         CAST(l_quantity * 10 AS BIGINT) AS retrieved_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey, cnt),
mv AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY chain, tx_hash, dedup_key
    ORDER BY retrieved_at, provider, ts, asset, amount, from_addr, to_addr, gas_price NULLS FIRST) = 1),
halves AS (
  SELECT chain, tx_hash, dedup_key, idx, CASE WHEN idx <= 2 THEN 'utxo_input' ELSE 'utxo_output' END AS kind, asset, verified, amount,
         CASE WHEN idx <= 2 THEN to_addr END AS from_addr, CASE WHEN idx > 2 THEN to_addr END AS to_addr, ts, gas_price FROM mv),
keys AS (SELECT s_suppkey AS k, s_nationkey AS nk, 'S' AS t FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'C' FROM customer),
lab AS (
  SELECT DISTINCT 'ledger' AS chain, concat('A', (k * 3) % n) AS address,
         concat(upper(n_name[1]), lower(n_name[2:]), ' ', k % 5) AS entity,
         ['vasp', 'vasp', 'mixer', 'sanctioned', 'infrastructure'][k % 5 + 1] AS category, ['deposit', 'hot', 'unknown'][k % 3 + 1] AS role,
         (k % 9 + 1) / 10 AS confidence, ['active', 'active', 'pending', 'retired'][k % 4 + 1] AS status,
         ['official', 'community', 'proof', 'heuristic'][k // 2 % 4 + 1] AS method, concat(t, k % 7) AS source,
         DATE '2019-01-01' + CAST(k % 2000 AS INTEGER) AS source_date
  FROM keys JOIN nation ON nk = n_nationkey, cnt)
"""


def sql(body: str) -> str:
    """``body`` with the views in scope; it may open with further expressions and ``SELECT``."""
    body = body.strip()
    return f"WITH {SQL.strip()}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"
