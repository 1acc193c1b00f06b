"""Business-listing analytics as Spark DataFrame jobs.

Every function takes and returns DataFrames or Columns; none creates a session.
"""

import sys

from pyspark import cloudpickle

# Python workers get the functions they run with the task, so that executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
