"""radiomap — Spark-native analytics for indoor radio-fingerprint surveys.

Every operator takes and returns Spark DataFrames. The working shape is the
long table ``reading(obs_id, ap_id, rssi)`` (absent row = AP not heard) next to
the scan table ``obs(obs_id, dataset, labels..., context...)``.
"""

from radiomap.session import build_session, shared_dir, ship

__all__ = ["build_session", "shared_dir", "ship"]
