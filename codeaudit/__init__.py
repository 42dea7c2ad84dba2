"""Code-quality, security and provenance analytics over many projects, on Spark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
