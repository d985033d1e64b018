"""Column expressions shared by the operators."""

from radiomap.functions.hashing import hash_key, hash_uniform
from radiomap.functions.signal import (FILL_DBM, NOT_HEARD, dbm_to_mw, fill_missing,
                                       sentinel_to_null, shifted)

__all__ = ["hash_key", "hash_uniform", "FILL_DBM", "NOT_HEARD", "dbm_to_mw", "fill_missing",
           "sentinel_to_null", "shifted"]
