"""Fleet exposure forensics as Spark jobs over tables of host evidence."""

import sys

from pyspark import cloudpickle

from fleetlens.session import configure
from fleetlens.spec import IndicatorSpec

# Functions sent to tasks carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["IndicatorSpec", "configure"]
