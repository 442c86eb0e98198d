"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Its functions travel with the tasks by
value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["palimpsest"])
