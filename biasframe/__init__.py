"""biasframe: toxicity and bias text analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions) and stays lazy, so Catalyst sees the whole
plan: filters reach the parquet scan, unused columns are pruned and
aggregations run partial-then-final.
"""

from biasframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
