"""tidemark: point-in-time risk features, selection and model evaluation on Spark.

Subpackages
-----------
sources    readers, column hygiene and sinks
functions  Column-level helpers (patterns, ratios, JSON fields, cut labels)
operators  DataFrame operators (trailing windows, as-of lookups, sessions,
           binning, information value, evaluation, training, attribution)
plans      fixture views over the test tables and the registered queries
"""

from tidemark.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
