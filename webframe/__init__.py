"""webframe: web-crawl data processing as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to executors with their code, so the package is needed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
