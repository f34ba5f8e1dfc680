"""tessera: document-retrieval lakehouse jobs written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors with their code, so the package needs to
# be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
