"""Per-row expressions (E1-E18).  All are built-in Spark expressions, so they
stay inside whole-stage codegen; none is a Python UDF."""

from postlake.functions.scalars import *  # noqa: F401,F403
