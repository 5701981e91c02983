"""wardflow: patient / visit / billing analytics as Spark jobs.

Every public operator is a function from DataFrames to DataFrames built on
the public PySpark DataFrame / SQL / ML API.  Nothing is collected to the
driver except 1-row parameter frames (percentile fences, medians).
"""

from wardflow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
