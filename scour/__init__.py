"""Retrieval corpus building and querying on Spark."""

import sys as _sys

try:  # ship this package's code inside every UDF / map function (no install
    # or --py-files needed on the executors)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
