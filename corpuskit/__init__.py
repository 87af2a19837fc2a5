"""corpuskit: retrieval and document analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function so it composes with ``df.transform`` and stays inside one lazy
Catalyst plan.
"""

import sys as _sys

# Python functions shipped to executors (the vector block product, the
# stateful stream folds, the pluggable embedder) are pickled by value, so
# workers need not find this package on their own path.
try:  # noqa: SIM105
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
    pass

from corpuskit.session import checkpoint_dir, get_spark  # noqa: E402
from corpuskit.tables import TABLES, load  # noqa: E402

__all__ = ["TABLES", "checkpoint_dir", "get_spark", "load"]
