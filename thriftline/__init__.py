"""Code-impact analytics on Spark: catalogue, measure, decide, patch, summarise."""

import sys

from pyspark import cloudpickle

# The small helpers that run inside tasks travel with the job, so executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from thriftline.session import configure  # noqa: E402

__all__ = ["configure"]
