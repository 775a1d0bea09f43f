"""Capacity and cost analytics over machine-usage time series, on Spark.

Every operator takes DataFrames and returns a DataFrame.  The few Python
kernels that run inside tasks are sent along with the job by value, so the
package does not have to be installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
