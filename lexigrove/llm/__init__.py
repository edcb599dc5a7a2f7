"""Training-data operators: cleaning, de-duplication, search and mixing of text corpora.

Nothing else in the library imports this subpackage.  Functions that run in Python workers are
pickled by value, so a cluster needs numpy and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
