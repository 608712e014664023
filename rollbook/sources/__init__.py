"""Where school tables come from and where snapshots go."""

from rollbook.sources.staging import release, stage
from rollbook.sources.tables import read_jdbc, read_school, write_snapshot

__all__ = ["read_jdbc", "read_school", "stage", "write_snapshot"]
