"""Reproducible randomness: hash order and hash uniforms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = 4294967296


def order_key(seed, key) -> Column:
    """A string whose byte order is the shuffled order of ``key``.

    It is 32 hash digits followed by the key itself: equal hashes fall back to
    the key, and a prefix of it is an evenly filled bucket number. A null key is
    a key of its own.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    key = F.col(key) if isinstance(key, str) else key
    key = F.coalesce(key.cast("string"), F.lit("\0"))
    return F.concat(F.md5(F.concat(seed.cast("string"), F.lit("|"), key)), key)


def hash_u32(*parts) -> Column:
    """An integer in [0, 2**32) drawn from the parts joined by ``|``."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A double in [0, 1) drawn from the parts."""
    return hash_u32(*parts) / F.lit(float(U32))
