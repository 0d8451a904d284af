"""clausewright: document ingest, retrieval and corpus preparation as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry the package's code with them: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
