"""treeline: source-tree reorganisation analytics on Spark.

Every table is keyed by ``repo_id`` so that many repositories are analysed in
one job. Operators are plain functions ``DataFrame -> DataFrame`` (use them
with ``df.transform``); rules are functions returning a ``Column``.
"""

from treeline.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
