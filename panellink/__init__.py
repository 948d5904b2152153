"""Longitudinal record linkage and entity resolution over panels of (organization, year, person) records."""

import sys

from pyspark import cloudpickle

# Python kernels travel to executors by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
