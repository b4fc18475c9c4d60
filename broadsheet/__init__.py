"""broadsheet: feeds, crawled pages and JSON documents as Spark tables.

Every public function takes and returns DataFrames or Columns and leaves the data work
to the executors. Plans are lazy; functions that fit a model, bound a broadcast or cut the
lineage run jobs while they build theirs, and say so.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
