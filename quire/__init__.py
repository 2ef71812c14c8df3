"""Scholarly-manuscript data operators for Spark.

Every public function takes and returns DataFrames (or Columns); nothing here
collects rows to the driver. See README.md for the operator list.
"""

from quire.profile import Profile

__all__ = ["Profile"]
