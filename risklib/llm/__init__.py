"""Training-data operators. Nothing outside this package imports it.

Python code that runs inside tasks is shipped by value with the plan, so the
workers need no copy of the package on their path.
"""

from pyspark import cloudpickle

import risklib

cloudpickle.register_pickle_by_value(risklib)
