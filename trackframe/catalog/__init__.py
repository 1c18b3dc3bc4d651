"""Named queries over the bundled tables, one or more for each operator, with the SQL that gives the same rows."""

from trackframe.catalog import clips, formulas, geometry, joins, sequences, skeletons, streams, vectors  # noqa: F401  they register their queries
from trackframe.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
