"""Imports every module that registers queries."""

from vexarium.plans import formats, merging, models, pages, products, quality, records, reporting, text  # noqa: F401
from vexarium.plans.registry import registered

__all__ = ["registered"]
