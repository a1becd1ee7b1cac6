"""Usage analytics over the local histories of coding agents, as Spark jobs.

Histories of many stores (one store = one home directory) are ingested from a
lake, normalised to a few content-free tables, de-duplicated, reconciled and
reduced to one report.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: only the driver needs the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
