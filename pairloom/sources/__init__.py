"""Readers. Every record gets its place in the input, since order decides which duplicate wins."""

from pyspark import cloudpickle

from pairloom.sources import archives

# Runs inside Python workers, see pairloom.functions.
cloudpickle.register_pickle_by_value(archives)
