"""Sources and sinks: table-name maps, fixture views, CSV/parquet writers."""

from .catalog import SOURCE_ROLES, read_parquet, read_sources
from .fixtures import source_views, wide_view
from .sinks import read_manifest, read_output, write_outputs

__all__ = ["SOURCE_ROLES", "read_manifest", "read_output", "read_parquet", "read_sources", "source_views", "wide_view",
           "write_outputs"]
