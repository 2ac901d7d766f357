"""Language-model training data preparation expressed as Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function, usable with ``df.transform``.
"""

from pyspark import cloudpickle

from tokenloom import kernels
from tokenloom.sources import prompt_files
from tokenloom.streaming import resumable

# Task-side helpers travel inside the serialized functions, so executors need no install step.
for _module in (kernels, prompt_files, resumable):
    cloudpickle.register_pickle_by_value(_module)
