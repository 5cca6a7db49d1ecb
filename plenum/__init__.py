"""Civic data analytics as Spark DataFrame and Column functions."""

import sys

from pyspark import cloudpickle

from plenum.session import build_session, cut_lineage

# Python stages travel with the plan, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
