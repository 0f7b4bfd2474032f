"""beamfold: coherent-ranging scan analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  The package is pickled by value into Python workers, so a cluster needs
no installation of it on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
