"""Column-level building blocks.

The modules that run inside Python workers are pickled by value, so that
executors do not need this package on their path.
"""

from pyspark import cloudpickle

from pairloom.functions import mutants, nested, python_source

for _module in (mutants, nested, python_source):
    cloudpickle.register_pickle_by_value(_module)
