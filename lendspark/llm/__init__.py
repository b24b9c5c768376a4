"""Training-data operators for corpora of documents, pages, vectors and chats."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
