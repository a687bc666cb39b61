"""Data quality and weekly-series anomaly analytics as Spark jobs.

Operators are functions from DataFrame to DataFrame; ``weekwatch.plans`` joins
them into the validation, cleaning and detection jobs.
"""

import sys

from pyspark import cloudpickle

from weekwatch.specs import Strata, TableSpec

# Functions of this package travel to the executors by value, so that none of them needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Strata", "TableSpec"]
