"""snapcase: Spark-native analysis of periodic case snapshots.

Daily per-item snapshot rows are turned into episodes, demographic profile
tables, item-pair association statistics, stratified contingency models and
population comparisons.  Every operator is a lazy ``DataFrame -> DataFrame``
function built from Spark SQL primitives; nothing is collected to the driver.
"""

from snapcase.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
