"""Reading tables, and cutting lineage through the cluster's shared folder."""

from flowfeat.sources.bindings import table
from flowfeat.sources.shared import cut, drop, shared_dir

__all__ = ["cut", "drop", "shared_dir", "table"]
