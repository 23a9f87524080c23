"""Column encryption with a password-derived key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key derivation.
ROUNDS = 100_000
KEY_BYTES = 32


def derive_key(password: str, salt: bytes) -> bytes:
    """PBKDF2-HMAC-SHA256 key, computed once on the driver.

    The caller supplies the salt: a random one, stored apart from the data. The
    key becomes a literal of the plan, so keep plans and event logs of such jobs
    as private as the key.
    """
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, KEY_BYTES)


def encrypt_col(plain: Column, key: bytes) -> Column:
    """AES-GCM token (nonce, ciphertext and tag) of a text or binary column."""
    return F.aes_encrypt(plain, F.lit(bytearray(key)), F.lit("GCM"))


def try_decrypt_col(token: Column, key: bytes) -> Column:
    """Bytes behind a token, NULL where the key is wrong or the token was changed."""
    return F.try_aes_decrypt(token, F.lit(bytearray(key)), F.lit("GCM"))


def decrypt_col(token: Column, key: bytes) -> Column:
    """Bytes behind a token; a wrong key or a changed token fails the query."""
    return F.aes_decrypt(token, F.lit(bytearray(key)), F.lit("GCM"))
