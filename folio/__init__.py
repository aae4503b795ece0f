"""Corpus packing on Spark: files and documents in, ordered packs and reports out."""

import sys

from pyspark import cloudpickle

from folio.options import PackOptions

# Python workers need no installed copy: functions travel with the query that uses them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PackOptions"]
