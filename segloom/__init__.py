"""segloom: document segmentation and bilingual production on Spark DataFrames.

The package is pickled by value into Python workers, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
