"""Operators for preparing training data: media, quality, search, toxicity, packing,
near-duplicates, licences, language, repeated passages and byte-pair encoding.

Nothing outside this subpackage imports it. Functions that run on executors travel by
value, so executors need only the libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
