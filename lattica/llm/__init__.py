"""Training-data operators.

One module holds one operator; ``queries`` binds them to tables.  Nothing
outside this folder imports it.  Functions of this folder are pickled by
value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
