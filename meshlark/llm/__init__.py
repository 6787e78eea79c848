"""Training-data operators: deduplication, extraction, scoring and scans.

Nothing else in the library imports this subpackage.  Python functions that run
on executors are shipped by value, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
