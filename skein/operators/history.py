"""Encrypted messages: one data key a user and day, bound to what is known of the message.

AES-GCM by Spark's own functions, so that neither keys nor texts leave the tasks' JVMs.
Cipher texts and nonces stand apart, as base64 for URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NONCE = 12  #: bytes
#: What a cipher text is bound to. Fixed values.
MESSAGE, KEY = "history-msg|v1|user:%s|agent:%s|role:%s|ts:%s", "history-dek|v1|user:%s|email:%s"


def _to_url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def _from_url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def bound_to_message(user: Column, agent: Column, role: Column, millis: Column) -> Column:
    """C8. What binds a message to its user, agent, role and time, so that none can be swapped."""
    return F.format_string(MESSAGE, user, agent, role, millis)


def bound_to_key(user: Column, email: Column) -> Column:
    """C8. What binds a wrapped key to its user and mail address."""
    return F.format_string(KEY, user, email)


def sealed(data: Column, key: Column, bound: Column) -> Column:
    """C8. struct(cipher, nonce) of a text or a key.

    The nonce is the start of a SHA-256 over key, binding and data: messages of one key
    differ in it unless they are equal, and a task that is run again gives the same.
    """
    raw = data.cast("binary")
    nonce = F.substring(F.unhex(F.sha2(F.concat(key, bound.cast("binary"), raw), 256)), 1, NONCE)
    whole = F.aes_encrypt(raw, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, bound.cast("binary"))
    return F.struct(_to_url(F.substring(whole, F.lit(NONCE + 1), F.length(whole))).alias("cipher"), _to_url(nonce).alias("nonce"))


def opened(cipher: Column, nonce: Column, key: Column, bound: Column) -> Column:
    """C8. The sealed bytes; null where key, cipher text or binding don't belong together."""
    return F.try_aes_decrypt(F.concat(_from_url(nonce), _from_url(cipher)), key, F.lit("GCM"), F.lit("DEFAULT"), bound.cast("binary"))


def day_of(ts: Column, days: int = 0) -> Column:
    """J11. The UTC day that names a key, from a time in milliseconds."""
    return F.date_format(F.date_add(F.to_date(F.to_utc_timestamp(F.timestamp_millis(ts), F.current_timezone())), days), "yyyyMMdd")


def with_keys(messages: DataFrame, keys: DataFrame) -> DataFrame:
    """J11. Messages (user_id, ts, ...) with the ``key`` of their day, else the day before, the day after, or the legacy key (day null).

    Four equality joins on (user, day), which Spark plans by size; no pairs are made and
    each message stays one row.
    """
    rows = messages
    for i, shift in enumerate((0, -1, 1)):
        named = keys.where("day is not null").select("user_id", F.col("day").alias("_d"), F.col("key").alias(f"_k{i}"))
        rows = rows.withColumn("_d", day_of(F.col("ts"), shift)).join(named, ["user_id", "_d"], "left").drop("_d")
    rows = rows.join(keys.where("day is null").select("user_id", F.col("key").alias("_k3")), "user_id", "left")
    return rows.withColumn("key", F.coalesce(*(F.col(f"_k{i}") for i in range(4)))).drop(*(f"_k{i}" for i in range(4)))


def rewrapped(wrapped: DataFrame, old: Column, new: Column, version: int) -> DataFrame:
    """C8. Wrapped keys (user_id, email, cipher, nonce, version) under a new master key; messages stay as they are.

    A key bound to the address ``unknown`` is opened too. What doesn't open, or has the version, stays as it is.
    """
    unknown = bound_to_key(F.col("user_id"), F.lit("unknown"))
    known = bound_to_key(F.col("user_id"), F.col("email"))
    rows = wrapped.withColumn("_plain", F.coalesce(opened(F.col("cipher"), F.col("nonce"), old, known), opened(F.col("cipher"), F.col("nonce"), old, unknown)))
    change = F.col("_plain").isNotNull() & (F.col("version") != version)
    rows = rows.withColumn("_new", F.when(change, sealed(F.col("_plain"), new, known)))
    return rows.withColumns({"cipher": F.coalesce("_new.cipher", "cipher"), "nonce": F.coalesce("_new.nonce", "nonce"), "version": F.when(change, version).otherwise(F.col("version"))}).drop("_plain", "_new")


def latest(messages: DataFrame, n: int) -> DataFrame:
    """W3. Each user's last n messages."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("message_id"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
