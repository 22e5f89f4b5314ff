"""Content processors: one function per object type, from bytes to symbols, metadata and child objects."""

from nestlake.processors import archives, binaries, compound, network, sevenzip, texts  # noqa: F401  (they register themselves)
from nestlake.processors.base import REGISTRY, Child, Job, Limits, Result, run

__all__ = ["REGISTRY", "Child", "Job", "Limits", "Result", "run"]
