"""Landed ledger records to movements: unspent outputs, account feeds, receipts, balance deltas, contract lists.

Each function takes a DataFrame of nested records as vendors ship them and returns movement
rows. Numbers arrive as decimal strings unless a schema says otherwise; a value that is no
number gives a null amount, and rows that a ledger's rules refuse are not movements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hex_to_decimal, hex_to_digits

# Fixed value: topic of the ERC-20 Transfer event.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
MONEY = "decimal(38,0)"
BASE = ["chain", "tx_hash", "dedup_key", "idx", "kind", "asset_kind", "contract", "symbol", "decimals", "amount", "amount_str", "from_addr", "to_addr", "ts", "block_number"]


def _digits(c: Column) -> Column:
    """A canonical non-negative decimal text, or null."""
    bare = F.regexp_replace(F.trim(c), "^0+(?=[0-9])", "")
    return F.when(bare.rlike("^[0-9]+$"), bare)


def _row(df: DataFrame, chain: str | Column, **cols: Column) -> DataFrame:
    """Movement rows with the given columns; amount follows from amount_str."""
    null = F.lit(None)
    defaults = {"idx": null.cast("int"), "contract": null.cast("string"), "symbol": null.cast("string"), "decimals": null.cast("int"), "block_number": null.cast("long"), "asset_kind": F.lit("native"), "from_addr": null.cast("string"), "to_addr": null.cast("string")}
    cols = defaults | cols | {"chain": F.lit(chain) if isinstance(chain, str) else chain}
    cols["amount"] = cols["amount_str"].try_cast(MONEY)
    return df.select(*[cols[c].alias(c) for c in BASE])


def utxo_movements(txs: DataFrame, chain: str = "bitcoin") -> DataFrame:
    """Input and output halves of confirmed transactions; positions are places in the arrays, coinbase inputs are none."""
    ok = txs.where("status.confirmed")
    time, height = F.timestamp_seconds("status.block_time"), F.col("status.block_height").cast("long")
    ins = ok.select("txid", "status", F.posexplode("vin").alias("pos", "h")).where("not coalesce(h.is_coinbase, false) and h.prevout.scriptpubkey_address is not null and h.prevout.value is not null")
    outs = ok.select("txid", "status", F.posexplode("vout").alias("pos", "h")).where("h.scriptpubkey_address is not null and h.value is not null")
    key = lambda p: F.concat(F.lit(p), F.col("pos").cast("string"))
    a = _row(ins, chain, tx_hash=F.col("txid"), dedup_key=key("in:"), idx=F.col("pos"), kind=F.lit("utxo_input"), amount_str=F.col("h.prevout.value").cast("string"), from_addr=F.col("h.prevout.scriptpubkey_address"), ts=time, block_number=height)
    b = _row(outs, chain, tx_hash=F.col("txid"), dedup_key=key("out:"), idx=F.col("pos"), kind=F.lit("utxo_output"), amount_str=F.col("h.value").cast("string"), to_addr=F.col("h.scriptpubkey_address"), ts=time, block_number=height)
    return a.unionByName(b)


def _filled(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def native_transfers(feed: DataFrame, chain: str) -> DataFrame:
    """Transfers of the native list: no error, value over 0; a creation goes to the contract it made."""
    to = F.lower(F.coalesce(_filled("to"), _filled("contractAddress")))
    rows = feed.where((F.coalesce("isError", F.lit("0")) != "1") & (_digits(F.col("value")) != "0") & to.isNotNull())
    return _row(rows, chain, tx_hash=F.lower("hash"), dedup_key=F.lit("native"), kind=F.lit("native"), amount_str=_digits(F.col("value")), from_addr=F.lower("from"), to_addr=to, ts=F.timestamp_seconds(F.col("timeStamp").try_cast("long")), block_number=F.col("blockNumber").try_cast("long"))


def token_transfers(feed: DataFrame, chain: str) -> DataFrame:
    """Token rows with both ends. The key has ends and contract only, so equal pairs of one transaction fold at the store."""
    ends = [F.lower(_filled("from")), F.lower(_filled("to")), F.lower(_filled("contractAddress"))]
    rows = feed.where(ends[0].isNotNull() & ends[1].isNotNull())
    return _row(
        rows, chain, tx_hash=F.lower("hash"), dedup_key=F.concat_ws(":", F.lit("token"), *[F.coalesce(e, F.lit("")) for e in ends]), kind=F.lit("token"), asset_kind=F.lit("token"),
        contract=ends[2], symbol=F.coalesce(_filled("tokenSymbol"), F.lit("TOKEN")), decimals=F.coalesce(F.col("tokenDecimal").try_cast("int"), F.lit(0)),
        amount_str=_digits(F.col("value")), from_addr=ends[0], to_addr=ends[1], ts=F.timestamp_seconds(F.col("timeStamp").try_cast("long")), block_number=F.col("blockNumber").try_cast("long"),
    )


def internal_transfers(feed: DataFrame, chain: str) -> DataFrame:
    """Internal traces: no error, value over 0, both ends; keyed by trace, else by content."""
    a, b, v = F.lower(_filled("from")), F.lower(F.coalesce(_filled("to"), _filled("contractAddress"))), _digits(F.col("value"))
    rows = feed.where((F.coalesce("isError", F.lit("0")) != "1") & (v != "0") & a.isNotNull() & b.isNotNull())
    key = F.when(_filled("traceId").isNotNull(), F.concat(F.lit("internal:"), _filled("traceId"))).otherwise(F.concat_ws(":", F.lit("internal"), a, b, v))
    return _row(rows, chain, tx_hash=F.lower("hash"), dedup_key=key, kind=F.lit("internal"), amount_str=v, from_addr=a, to_addr=b, ts=F.timestamp_seconds(F.col("timeStamp").try_cast("long")), block_number=F.col("blockNumber").try_cast("long"))


def transactions(native: DataFrame, token: DataFrame, internal: DataFrame) -> DataFrame:
    """One row a transaction over three feeds: which feeds have it, base feed, its gas price.

    The base is the native list, else tokens, else traces; the price is the first that parses in
    that order. A union with one aggregate does what three full joins would, in one shuffle.
    """
    feeds = None
    for rank, f in enumerate((native, token, internal)):
        price = _digits(F.col("gasPrice")).try_cast(MONEY) if "gasPrice" in f.columns else F.lit(None).cast(MONEY)
        rows = f.select(F.lower("hash").alias("tx_hash"), F.lit(rank).alias("feed"), price.alias("price"))
        feeds = rows if feeds is None else feeds.unionByName(rows)
    count = lambda k: F.count_if(F.col("feed") == k)
    names = F.array(F.lit("native"), F.lit("token"), F.lit("internal"))
    return feeds.groupBy("tx_hash").agg(
        count(0).alias("n_native"), count(1).alias("n_token"), count(2).alias("n_internal"), F.get(names, F.min("feed")).alias("base"),
        F.min(F.when(F.col("price").isNotNull(), F.struct("feed", "price"))).getField("price").alias("gas_price"),
    )


def stamped(movements: DataFrame, txs: DataFrame) -> DataFrame:
    """Movements with the gas price of their transaction, internal ones included."""
    return movements.join(txs.select("tx_hash", "gas_price"), "tx_hash", "left")


def _with_digits(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``_digits``: the exact decimal digits of hex of any width.

    Built-ins decode what fits 38 digits; only the few rows past that go through Python.
    """
    small = rows.withColumn("_digits", hex_to_decimal(text).cast("string"))
    wide = small.where(F.col("_digits").isNull() & text.isNotNull()).withColumn("_digits", hex_to_digits(text))
    return small.where("_digits is not null").unionByName(wide.where("_digits is not null"))


def receipt_movements(receipts: DataFrame, chain: str) -> DataFrame:
    """Native and Transfer-log movements of receipts that succeeded.

    A log counts with exactly three topics, the Transfer topic and 64 hex digits of data; its
    ends are the last 40 digits of topics 1 and 2. Values past 38 digits keep their digits in
    ``amount_str``; ``amount`` is null there.
    """
    status = hex_to_decimal(F.col("receipt.status"))
    good = receipts.where((status == 1) | (F.col("receipt.status").isNull() & F.col("receipt.root").isNotNull()))
    time, block = F.timestamp_seconds("time"), hex_to_decimal(F.col("blockNumber")).cast("long")
    to = F.lower(F.coalesce(_filled("to"), F.col("receipt.contractAddress")))
    paid = _with_digits(good.where(to.isNotNull()), F.col("value"))
    native = _row(paid.where("_digits <> '0'"), chain, tx_hash=F.lower("hash"), dedup_key=F.lit("native"), kind=F.lit("native"), amount_str=F.col("_digits"), from_addr=F.lower("from"), to_addr=to, ts=time, block_number=block)
    logs = good.select("hash", "time", "blockNumber", F.explode("receipt.logs").alias("l"))
    logs = logs.where((F.size("l.topics") == 3) & (F.lower(F.col("l.topics")[0]) == TRANSFER) & F.col("l.data").rlike("^0x[0-9a-fA-F]{64}$"))
    end = lambda i: F.concat(F.lit("0x"), F.lower(F.right(F.col("l.topics")[i], F.lit(40))))
    idx = hex_to_decimal(F.col("l.logIndex")).cast("int")
    logs = _with_digits(logs, F.col("l.data"))
    token = _row(logs, chain, tx_hash=F.lower("hash"), dedup_key=F.concat(F.lit("log:"), idx.cast("string")), idx=idx, kind=F.lit("token"), asset_kind=F.lit("token"), contract=F.lower("l.address"), amount_str=F.col("_digits"), from_addr=end(1), to_addr=end(2), ts=time, block_number=block)
    return native.unionByName(token)


def rpc_gas_price(receipt_price: Column, tx_price: Column) -> Column:
    """Effective price of the receipt, else the transaction's; caps are never prices."""
    return F.coalesce(hex_to_decimal(receipt_price), hex_to_decimal(tx_price))


def balance_deltas(txs: DataFrame, chain: str = "solana") -> DataFrame:
    """Input and output halves from balances before and after; failed transactions have none.

    The fee payer (account 0) gets the fee added back; balance arrays of different lengths give
    no native rows. Tokens differ by (account index, mint), a missing side is 0, and need an owner.
    """
    ok = txs.where("meta.err is null")
    keys, time = F.col("transaction.message.accountKeys.pubkey"), F.timestamp_seconds("blockTime")
    same = ok.where((F.size("meta.preBalances") == F.size("meta.postBalances")) & (F.size(keys) >= F.size("meta.preBalances")))
    each = same.select("signature", "slot", time.alias("time"), "meta.fee", keys.alias("keys"), F.posexplode(F.arrays_zip(F.col("meta.preBalances").alias("pre"), F.col("meta.postBalances").alias("post"))).alias("i", "b"))
    fields = each.schema["b"].dataType.fieldNames()
    delta = F.col(f"b.`{fields[1]}`") - F.col(f"b.`{fields[0]}`") + F.when(F.col("i") == 0, F.col("fee")).otherwise(0)
    native = each.select("signature", "slot", "time", F.col("keys")[F.col("i")].alias("owner"), F.lit(None).cast("string").alias("mint"), F.lit(None).cast("int").alias("decimals"), F.col("i").alias("i"), delta.cast(MONEY).alias("d"))
    token = lambda side: ok.select("signature", "slot", time.alias("time"), F.explode(f"meta.{side}TokenBalances").alias("t")).select("signature", "slot", "time", F.col("t.accountIndex").alias("i"), "t.mint", "t.owner", "t.uiTokenAmount.decimals", (F.col("t.uiTokenAmount.amount").try_cast(MONEY) * (1 if side == "post" else -1)).cast(MONEY).alias("a"))
    both = token("pre").unionByName(token("post")).groupBy("signature", "slot", "time", "i", "mint").agg(F.max("owner").alias("owner"), F.max("decimals").alias("decimals"), F.try_sum("a").cast(MONEY).alias("d")).where("owner is not null")
    rows = native.unionByName(both.select(*native.columns)).where("d <> 0")
    spent = F.col("d") < 0
    end = F.when(F.col("mint").isNull(), F.concat(F.lit("sol:"), F.col("i").cast("string"))).otherwise(F.concat_ws(":", F.lit("spl"), F.col("i").cast("string"), "mint"))
    return _row(
        rows, chain, tx_hash=F.col("signature"), dedup_key=end, idx=F.col("i").cast("int"), kind=F.when(spent, "utxo_input").otherwise("utxo_output"), asset_kind=F.when(F.col("mint").isNull(), "native").otherwise("token"),
        contract=F.col("mint"), decimals=F.col("decimals"), amount_str=F.abs("d").cast("string"), from_addr=F.when(spent, F.col("owner")), to_addr=F.when(~spent, F.col("owner")), ts=F.col("time"), block_number=F.col("slot"),
    )


def contract_movements(txs: DataFrame, chain: str = "tron") -> DataFrame:
    """Native transfers of contract lists: some result is SUCCESS, type TransferContract, amount over 0, time over 0."""
    ok = txs.where(F.exists("ret", lambda r: r["contractRet"] == "SUCCESS") & (F.col("block_timestamp") > 0))
    each = ok.select("txID", "blockNumber", "block_timestamp", F.posexplode("raw_data.contract").alias("i", "c")).where("c.type = 'TransferContract' and c.parameter.value.amount > 0")
    v = "c.parameter.value"
    return _row(each, chain, tx_hash=F.col("txID"), dedup_key=F.concat(F.lit("trx:"), F.col("i").cast("string")), idx=F.col("i"), kind=F.lit("native"), amount_str=F.col(f"{v}.amount").cast("string"), from_addr=F.col(f"{v}.owner_address"), to_addr=F.col(f"{v}.to_address"), ts=F.timestamp_millis("block_timestamp"), block_number=F.col("blockNumber"))


def trc20_movements(rows: DataFrame, chain: str = "tron") -> DataFrame:
    """Token transfers of type Transfer with both ends and an amount over 0."""
    v = _digits(F.col("value"))
    ok = rows.where((F.col("type") == "Transfer") & _filled("from").isNotNull() & _filled("to").isNotNull() & (v != "0") & (F.col("block_timestamp") > 0))
    return _row(ok, chain, tx_hash=F.col("transaction_id"), dedup_key=F.concat_ws(":", F.lit("trc20"), "from", "to", "token_info.address", v), kind=F.lit("token"), asset_kind=F.lit("token"), contract=F.col("token_info.address"), symbol=F.coalesce("token_info.symbol", F.lit("TOKEN")), decimals=F.coalesce("token_info.decimals", F.lit(0)), amount_str=v, from_addr=F.col("from"), to_addr=F.col("to"), ts=F.timestamp_millis("block_timestamp"))


def scoped(movements: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Movements from ``since`` to ``until``, both included, either open."""
    out = movements if since is None else movements.where(F.col("ts") >= F.lit(since).cast(movements.schema["ts"].dataType))
    return out if until is None else out.where(F.col("ts") <= F.lit(until).cast(movements.schema["ts"].dataType))


def bridge_hints(movements: DataFrame, bridges: DataFrame) -> DataFrame:
    """One hint a transaction, bridge and direction: into a registered bridge a deposit, out of it a withdrawal."""
    b = bridges.select("chain", F.col("address").alias("bridge_address"), "bridge_id").distinct()
    into = movements.join(b.withColumnRenamed("bridge_address", "to_addr"), ["chain", "to_addr"]).select("chain", "tx_hash", "bridge_id", F.lit("deposit").alias("direction"), F.col("from_addr").alias("address"))
    out = movements.join(b.withColumnRenamed("bridge_address", "from_addr"), ["chain", "from_addr"]).select("chain", "tx_hash", "bridge_id", F.lit("withdrawal").alias("direction"), F.col("to_addr").alias("address"))
    return into.unionByName(out).groupBy("chain", "tx_hash", "bridge_id", "direction").agg(F.min("address").alias("address"))


def bridge_findings(hints: DataFrame) -> DataFrame:
    """A finding an address, bridge and direction: how many transactions and the first of them, confidence 0.8."""
    return hints.where("address is not null").groupBy("chain", "address", "bridge_id", "direction").agg(F.count("*").alias("n_txs"), F.min("tx_hash").alias("ref"), F.lit(0.8).alias("confidence"))


def feed_gaps(manifest: DataFrame, limit: int = 500) -> DataFrame:
    """By address: codes of feeds that were lost, and whether what was read is truncated.

    A manifest row tells one feed of one address: status, more (another page exists), rows read.
    """
    lost = F.array_sort(F.collect_set(F.when(F.col("status") != "ok", F.col("feed"))))
    cut = F.bool_or(F.coalesce("more", F.lit(False)) | (F.col("status") != "ok") | (F.col("n_rows") >= limit))
    return manifest.groupBy("chain", "address").agg(lost.alias("lost"), cut.alias("truncated"))
