"""tracemill: Spark jobs over coding-agent transcripts, tool results and token ledgers."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
