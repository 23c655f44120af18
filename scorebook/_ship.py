"""Ship worker-side code with the task instead of requiring the package on executors.

Functions handed to ``mapInPandas`` / ``applyInPandas`` are normally pickled by
reference (module + name), so every Python worker would have to import ``scorebook``.
Registering a module for pickling by value sends the function bodies with the task.
"""

from __future__ import annotations

import sys


def ship(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to import by name
        pass
