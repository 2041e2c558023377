"""Log analytics, alert routing and corpus preparation as PySpark jobs.

Functions that run in Python workers travel with the job (pickled by value), so executors need
neither this package installed nor a copy shipped by hand."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
