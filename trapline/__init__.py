"""trapline - camera-trap wildlife analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors receive the small Python helpers by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
