"""lexiframe: text-corpus preparation and evaluation operators on Spark DataFrames."""

import sys

__version__ = "0.1.0"

# UDF bodies defined in this package are shipped by value with each task, so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile
    pass
