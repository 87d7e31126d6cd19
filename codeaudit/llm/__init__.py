"""Operators for preparing training data, their queries and the SQL forms of these.

Functions of this package that run inside tasks are sent to the executors with the job,
so a cluster needs no copy of the package on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
