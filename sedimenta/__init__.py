"""sedimenta: content-aware archival analytics as Spark queries."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Python workers need no copy of this package
