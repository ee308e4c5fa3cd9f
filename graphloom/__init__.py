"""Graphloom: building, cleaning and querying confidence-scored graphs of extracted entities on Spark.

functions   column expressions (identity, text, confidence)
sources     readers and their pure column logic
operators   DataFrame to DataFrame operators
plans       the query catalogue over the test tables, with SQL to check it against
streaming   Structured Streaming forms of the incremental operators
llm         operators for training data; nothing outside that subpackage imports it
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
