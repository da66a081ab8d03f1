"""Where datasets and logs live: Parquet folders, written once and never changed in place."""

from grainwise.store.workspace import Workspace

__all__ = ["Workspace"]
