"""scorebook: distributed evaluation analytics for classification results on Spark.

The fact table is one row per (sample, condition) where a condition is a tuple of
grouping columns (by default ``model_name`` x ``prompt_id``).  Every operator that
touches the fact table is a DataFrame aggregation, join or window; only tables the
size of the condition list (or of the condition-pair list) are ever small enough to
be collected.
"""

from scorebook.config import DEFAULT_GROUP_COLS, DEFAULT_LABELS, LabelSpec

__all__ = ["DEFAULT_GROUP_COLS", "DEFAULT_LABELS", "LabelSpec"]
