"""All queries of the library outside the text-preparation subpackage."""

from flowfeat.plans import basins, catalog, evaluation, history, scalars, series, streams  # noqa: F401
from flowfeat.plans._base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
