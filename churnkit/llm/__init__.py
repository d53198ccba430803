"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its task functions are
shipped to the executors by value, so the cluster's Python needs the listed
third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
