"""Deterministic randomness: every draw is a hash of its key, so reruns, retries and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed: str, *cols: Column | str) -> Column:
    """md5 of seed and key parts joined by ``|``: the order of a random permutation."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]).cast("binary"))


def uniform(seed: str, *cols: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of :func:`hash_key`.

    Leave a key part out to share a stream (common random numbers), put it in to have one of its own.
    """
    return F.conv(F.substring(hash_key(seed, *cols), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
