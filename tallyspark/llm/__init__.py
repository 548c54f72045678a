"""Operators for large-scale training-data pipelines. Nothing else in the library imports them.

Executors do not need this package installed: its functions travel with the jobs that use them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
