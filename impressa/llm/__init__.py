"""Training-data operators: corpus filtering, deduplication, scoring and formatting.

Nothing outside this package imports it.  The Python functions that run inside
tasks are shipped by value, so executors need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
