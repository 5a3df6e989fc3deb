"""siterank: find, enrich and rank point sites with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel to the executors with the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
