"""kiln: operational-data analytics on Spark (DataFrame / SQL / Structured Streaming).

Python code that runs inside tasks (pandas UDFs of the blocked k-NN scorer)
is pickled *by value*, so executors need no copy of this package installed.
"""

from __future__ import annotations

import sys

try:  # pragma: no cover - exercised whenever a pandas UDF is shipped
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
