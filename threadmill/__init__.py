"""threadmill: Spark-native analytics over labelled online-discussion data."""

import sys

from pyspark import cloudpickle

from threadmill.runtime import local_session, read_table, shared_dir, write_shared

__all__ = ["local_session", "read_table", "shared_dir", "write_shared"]

# Functions that run in Python workers travel with the plan, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
