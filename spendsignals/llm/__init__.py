"""Operators for preparing training data (chat formatting to WARC archives).

Nothing outside this package and ``corpus_pipeline.py`` imports it. ``queries.py`` registers one query
per operator; the driver's entry module adds them when the package can be imported.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: executors need no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
