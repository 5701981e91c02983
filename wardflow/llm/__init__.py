"""Training-data operators for large text corpora.

Nothing outside this package imports it.  Each module holds one operator with
its own interface; ``registry`` holds the thin queries and their SQL.

The worker-side functions are shipped by value, so executors need no copy of
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
