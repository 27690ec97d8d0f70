"""A knowledge-retrieval and analytics library on PySpark: documents in, ranked and filtered answers out."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
