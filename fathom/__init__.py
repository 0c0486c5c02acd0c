"""fathom: document-drift analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions given to Arrow workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
