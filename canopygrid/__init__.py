"""Land-cover-change risk analytics on Spark pixel tables."""

import sys

from pyspark import cloudpickle

from canopygrid.grid import GridSpec

# Functions sent to executors travel with the job, so workers need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["GridSpec"]
