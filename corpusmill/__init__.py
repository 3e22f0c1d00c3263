"""Document-corpus analytics as Spark DataFrame transformations."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
