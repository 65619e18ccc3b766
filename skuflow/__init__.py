"""skuflow: Spark-native inventory and supply-chain analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, so Catalyst sees the whole plan (pushdown, pruning, codegen, AQE).
"""

from skuflow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
