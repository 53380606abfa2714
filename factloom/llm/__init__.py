"""Operators for preparing language-model training data; nothing else in the library imports this package."""

from pyspark import cloudpickle

import factloom

# Task functions travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(factloom)
