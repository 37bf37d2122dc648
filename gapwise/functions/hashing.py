"""Reproducible randomness: every draw is a function of a seed and a row key.

Unlike ``rand()`` the values do not depend on partitioning, so they survive
recomputation after an executor is lost and can be checked from SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

RANK_BITS = 60


def _as_column(part) -> Column:
    return F.col(part) if isinstance(part, str) else part


def digest(seed, *parts) -> Column:
    """md5 of the seed and the parts, joined with ``|``; strings name columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)),
                             *[_as_column(p).cast("string") for p in parts]))


def uniform(seed, *parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the digest."""
    head = F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10)
    return head.cast("bigint").cast("double") / F.lit(4294967296.0)


def hash_rank(seed, *parts) -> Column:
    """A 60-bit integer; ascending order is a random permutation of the rows."""
    return F.conv(F.substring(digest(seed, *parts), 1, RANK_BITS // 4), 16, 10).cast("bigint")


def driver_digest(seed, *parts) -> str:
    return hashlib.md5("|".join(str(p) for p in (seed, *parts)).encode()).hexdigest()


def driver_uniform(seed, *parts) -> float:
    """The same draw as :func:`uniform`, for choices made once per job."""
    return int(driver_digest(seed, *parts)[:8], 16) / 4294967296.0
