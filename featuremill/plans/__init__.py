"""The registered queries of the library."""

from . import datasets, features, field_aware, fits_and_streams, more, tables_and_quality, versioned_and_wide
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "datasets", "features", "field_aware", "fits_and_streams", "more", "tables_and_quality", "versioned_and_wide"]
