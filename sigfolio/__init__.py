"""Filing-signal and portfolio analytics on Spark."""

import sys as _sys


def _ship_by_value() -> None:
    """Pickle this package's functions by value in Python UDFs
    (applyInPandas / mapInPandas), so executors need no copy of the package
    on their path -- the same code runs on a cluster without --py-files."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: ship with --py-files instead
        pass


_ship_by_value()
