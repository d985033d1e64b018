"""Seeded, partition-independent pseudo-randomness from md5.

``rand(seed)``, ``sample`` and ``randomSplit`` depend on how rows are laid
out across partitions, so re-running after a repartition or an executor loss
can pick other rows. A hash of (seed, key) gives every row the same draw on
every run and in every engine: DuckDB computes the identical value with
``CAST(('0x' || substr(md5(concat_ws(':', seed, key)), 1, 13)) AS BIGINT)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits, exactly representable in a double.
_HEX_DIGITS = 13
_SCALE = float(2 ** 52)


def _as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def hash_key(seed: int, *keys) -> Column:
    """md5 hex of ``seed:key1:key2...``; a total order used to shuffle rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_as_col(k).cast("string") for k in keys]))


def hash_uniform(seed: int, *keys) -> Column:
    """A value in [0, 1) drawn from (seed, keys), identical on every run."""
    prefix = F.substring(hash_key(seed, *keys), 1, _HEX_DIGITS)
    return F.conv(prefix, 16, 10).cast("bigint").cast("double") / F.lit(_SCALE)


def sql_hash_key(seed: int, *keys: str) -> str:
    """The DuckDB / ANSI text of :func:`hash_key` (for oracle queries)."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def sql_hash_uniform(seed: int, *keys: str) -> str:
    return (f"(CAST(CAST(('0x' || substr({sql_hash_key(seed, *keys)}, 1, {_HEX_DIGITS})) AS BIGINT) AS DOUBLE)"
            f" / {int(_SCALE)})")
