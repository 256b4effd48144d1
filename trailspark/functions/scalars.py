"""Scalar rules over ledger text: hex amounts, Base58Check, address families, query kinds."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Address patterns of the supported ledgers.
EVM_ADDRESS = r"^0[xX][0-9a-fA-F]{40}$"
BITCOIN_LEGACY = r"^[13][1-9A-HJ-NP-Za-km-z]{25,34}$"
BITCOIN_BECH32 = r"^(?i)bc1[02-9ac-hj-np-z]{11,71}$"
TRON_ADDRESS = r"^T[1-9A-HJ-NP-Za-km-z]{33}$"
SOLANA_ADDRESS = r"^[1-9A-HJ-NP-Za-km-z]{43,44}$"
EVM_LEDGERS = ("ethereum", "bsc", "polygon", "arbitrum", "base", "optimism")
#: Unsigned hex with or without 0x, at most 75 digits.
HEX = "^(0[xX])?[0-9a-fA-F]{1,75}$"
# Fixed value: the Base58 alphabet.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def hex_to_decimal(text: Column) -> Column:
    """Unsigned hex (with or without 0x) as decimal(38,0) by built-ins; null past 38 digits or if it is no hex.

    The significant digits are taken once; up to 15 of them need one ``conv``. More are three
    limbs of 15 digits; sums and products that overflow give null.
    """
    d = lambda v: F.lit(v).cast("decimal(38,0)")

    def told(sig: Column) -> Column:
        full = F.lpad(sig, 45, "0")
        limb = lambda i: F.conv(F.substring(full, 45 - 15 * (i + 1) + 1, 15), 16, 10).cast("decimal(38,0)")
        scaled = lambda i: F.try_multiply(limb(i), d(str(16 ** (15 * i)))).cast("decimal(38,0)")
        wide = F.try_add(F.try_add(limb(0), scaled(1)).cast("decimal(38,0)"), scaled(2)).cast("decimal(38,0)")
        return F.when(F.length(sig) <= 15, F.conv(sig, 16, 10).cast("decimal(38,0)")).when(F.length(sig) <= 45, wide)

    found = F.regexp_extract(text, "^(?:0[xX])?(?=[0-9a-fA-F])0*([0-9a-fA-F]*)$", 1)
    bound = F.get(F.transform(F.array(F.when(text.rlike(HEX), F.when(found == "", "0").otherwise(found))), told), F.lit(0))
    return bound


@F.pandas_udf(T.StringType())
def hex_to_digits(text: pd.Series) -> pd.Series:
    """Exact decimal digits of hex of any width, for values past 38 digits; null if it is no hex."""

    def one(t):
        try:
            return str(int(t.removeprefix("0x").removeprefix("0X"), 16)) if t else None
        except ValueError:
            return None

    return text.map(one, na_action="ignore")


def _base58_digits(raw: np.ndarray) -> np.ndarray:
    """Base-58 digits, most significant first, of rows of big-endian bytes: schoolbook division over the whole batch."""
    width = -(-raw.shape[1] * 138 // 100) + 1
    digits = np.zeros((len(raw), width), dtype=np.uint32)
    for byte in raw.T:
        carry = byte.astype(np.uint32)
        for k in range(width - 1, -1, -1):
            carry += digits[:, k] << np.uint32(8)
            digits[:, k] = carry % 58
            carry //= 58
    return digits


@F.pandas_udf(T.StringType())
def base58check(text: pd.Series) -> pd.Series:
    """Base58Check of 21-byte hex that opens with 41; any other text is returned as it is."""
    bare = text.str.replace("^0x", "", regex=True)
    fits = bare.str.fullmatch("41[0-9a-fA-F]{40}").fillna(False).astype(bool)
    if not fits.any():
        return text
    plain = [bytes.fromhex(t) for t in bare[fits]]
    ends = [hashlib.sha256(hashlib.sha256(b).digest()).digest()[:4] for b in plain]
    digits = _base58_digits(np.frombuffer(b"".join(a + b for a, b in zip(plain, ends)), dtype=np.uint8).reshape(len(plain), 25))
    letters = np.array(list(BASE58))[digits]
    # the first byte is 0x41, so no leading zero byte has to be kept as a 1
    first = (digits != 0).argmax(axis=1)
    out = text.copy()
    out[fits] = ["".join(row[k:]) for row, k in zip(letters, first)]
    return out


def with_base58(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` with the Base58Check form of ``column``: encoded once for each distinct value, then joined."""
    forms = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(to, base58check(column))
    return df.join(forms, column, "left")


def families(address: Column) -> Column:
    """Ledgers whose pattern an address fits, in a fixed order; several are ambiguous, none is unknown."""
    evm = [F.when(address.rlike(EVM_ADDRESS), F.lit(x)) for x in EVM_LEDGERS]
    bitcoin = F.when(address.rlike(BITCOIN_LEGACY) | address.rlike(BITCOIN_BECH32), F.lit("bitcoin"))
    tron = F.when(address.rlike(TRON_ADDRESS), F.lit("tron"))
    solana = F.when(address.rlike(SOLANA_ADDRESS) & ~address.rlike(TRON_ADDRESS) & ~address.rlike(BITCOIN_LEGACY) & ~address.rlike(BITCOIN_BECH32), F.lit("solana"))
    return F.array_compact(F.array(*evm, bitcoin, tron, solana))


def resolved(addresses: DataFrame, movements: DataFrame) -> DataFrame:
    """(address, candidates, ledger): ambiguous families narrow to the one ledger with history, if it is one."""
    cand = addresses.select("address").distinct().withColumn("candidates", families(F.col("address")))
    each = cand.select("address", F.explode("candidates").alias("chain"))
    ends = movements.select("chain", F.col("from_addr").alias("address")).unionByName(movements.select("chain", F.col("to_addr").alias("address")))
    live = each.join(ends, ["chain", "address"], "left_semi").groupBy("address").agg(F.collect_list("chain").alias("live"))
    out = cand.join(live, "address", "left")
    one = F.when(F.size("candidates") == 1, F.col("candidates")[0]).when(F.size("live") == 1, F.col("live")[0])
    return out.select("address", "candidates", one.alias("ledger"))


def query_kind(query: Column) -> Column:
    """What a search text is: address, tx, block, or unknown; at most 120 characters are considered a query."""
    q = F.trim(query)
    hex64 = q.rlike("^(0[xX])?[0-9a-fA-F]{64}$")
    return (
        F.when(q.isNull() | (F.length(q) == 0) | (F.length(q) > 120), "unknown")
        .when(q.rlike("^block:[0-9]+$") | q.rlike("^[0-9]{1,12}$"), "block")
        .when(hex64, "tx")
        .when(q.rlike(EVM_ADDRESS) | q.rlike("^[0-9a-fA-F]{40}$"), "address")
        .when(q.rlike(BITCOIN_BECH32) | q.rlike(BITCOIN_LEGACY) | q.rlike(TRON_ADDRESS), "address")
        .when(q.rlike("^[1-9A-HJ-NP-Za-km-z]{80,90}$"), "tx")
        .when(q.rlike(SOLANA_ADDRESS), "address")
        .otherwise("unknown")
    )
