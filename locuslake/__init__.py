"""locuslake: allelic-profile analytics and large-table data preparation on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions shipped to executors travel by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
