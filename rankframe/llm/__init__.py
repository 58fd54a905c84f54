"""Training-data operators: formatting, cleaning, scoring, mixing, sharding.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it is present.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so they need no
# copy of it (no --py-files).
cloudpickle.register_pickle_by_value(sys.modules[__name__])
