"""Training-data operators at corpus scale; nothing else in the library imports this subpackage.

Functions that run in Python workers are sent with the job, so that executors
need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
