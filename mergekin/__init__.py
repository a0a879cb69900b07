"""mergekin: entity resolution and record linkage as Spark DataFrame operators.

Every operator takes and returns DataFrames, declares its plan with built-in
expressions, and leaves the physical strategy to Catalyst.  Python runs only
where an operator cannot be expressed in SQL, and then on Arrow batches of
distinct values.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
