"""Sequence-sketch analytics on Spark: k-mer sketches, barcode incidence, mapping and overlaps."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from .spec import DEFAULT_FACTOR, HashSpec, LINKED_READ_SPEC, SKETCH_SPEC

# Functions travel to the executors by value, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT_FACTOR", "HashSpec", "LINKED_READ_SPEC", "SKETCH_SPEC"]
