"""Sealed personal columns: AES-GCM under one key per subject, erased by forgetting the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "tidemark:enc:v1:"
ERASED = "<erased>"


def associated(table: str, key: Column, column_id: int) -> Column:
    return F.concat_ws("/", F.lit("tidemark"), F.lit(table), key, F.lit(str(column_id)))


def seal(value: Column, key: Column, aad: Column) -> Column:
    """Base64 text behind PREFIX; NULL stays NULL, a value without a key is marked as erased."""
    body = F.base64(F.aes_encrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad))
    return F.when(value.isNull(), None).when(key.isNull(), F.lit(ERASED)).otherwise(F.concat(F.lit(PREFIX), body))


def unseal(value: Column, key: Column, aad: Column) -> Column:
    """Sealed text opened; what cannot be opened reads as erased, what is not sealed stays."""
    body = F.unbase64(F.substring(value, len(PREFIX) + 1, 1 << 30))
    plain = F.try_aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
    return F.when(value.startswith(PREFIX), F.coalesce(plain, F.lit(ERASED))).otherwise(value)


def wrap(key: Column, wrapping_key: bytes, subject: Column) -> Column:
    """A subject's key under the wrapping key, bound to the subject; NULL stays NULL."""
    return F.aes_encrypt(key, F.lit(bytearray(wrapping_key)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.encode(subject, "UTF-8"))


def unwrap(wrapped: Column, wrapping_key: bytes, subject: Column) -> Column:
    """The key, or NULL where it was forgotten or wrapped under another one."""
    return F.try_aes_decrypt(wrapped, F.lit(bytearray(wrapping_key)), F.lit("GCM"), F.lit("DEFAULT"), F.encode(subject, "UTF-8"))


def with_keys(rows: DataFrame, keys: DataFrame, subject: str) -> DataFrame:
    """Adds __key of each row's subject from keys (subject, key); subjects without one get NULL."""
    return rows.join(keys.select(F.col("subject").alias("__subject"), F.col("key").alias("__key")), F.col(subject).cast("string") == F.col("__subject"), "left").drop("__subject")
