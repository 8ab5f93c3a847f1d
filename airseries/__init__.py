"""airseries: sensor time-series analytics expressed as Spark DataFrame plans.

Location is always a grouping key, never a driver-side loop, so five sensors
or five million run the same plan.
"""

from airseries.session import get_session, checkpoint_dir, cut_lineage  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
