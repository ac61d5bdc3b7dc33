"""Millrace: corpus, training-set, score, retrieval and run-log work as Spark jobs.

Every operator is a function from DataFrame to DataFrame.  The package is
pickled by value, so Arrow functions run on executors that do not have it
installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
