"""Tokens and stable token hashes, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What counts as a token, the size of the sparse index space and
# the suffix that separates the sign hash from the position hash.
TOKEN_PATTERN = "[a-z0-9]+"
SPARSE_SPACE = 2**31
SIGN_SUFFIX = "#sign"


def tokenize(text: Column) -> Column:
    """All lowercase runs of ``[a-z0-9]``; null text has no tokens."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0))


def _hex_chunk(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")


def hash_mod(token: Column, modulus: int) -> Column:
    """md5 of the token, read as a 128-bit integer, modulo ``modulus`` (<= 2^31)."""
    if not 1 <= modulus <= 2**31:
        raise ValueError("modulus must be in 1..2^31")
    digest = F.md5(token)
    m = F.lit(modulus).cast("bigint")
    if modulus & (modulus - 1) == 0:
        return F.pmod(_hex_chunk(digest, 25, 8), m)
    # 2 + 15 + 15 hex digits: every intermediate value stays below 2^63.
    step = F.lit(16**15 % modulus).cast("bigint")
    head = F.pmod(_hex_chunk(digest, 1, 2), m)
    middle = F.pmod(head * step + _hex_chunk(digest, 3, 15), m)
    return F.pmod(middle * step + _hex_chunk(digest, 18, 15), m)


def hash_sign(token: Column) -> Column:
    """+1 or -1 from the parity of the md5 of the suffixed token."""
    last = F.substring(F.md5(F.concat(token, F.lit(SIGN_SUFFIX))), 32, 1)
    return F.when(last.isin(*"02468ace"), F.lit(1)).otherwise(F.lit(-1))


def vocabulary(words: Column) -> Column:
    """Words of a space-separated vocabulary, in order, repeats kept."""
    return F.filter(F.split(words, " "), lambda w: w != "")
