"""Query plans over the driver's tables."""

from . import basics, records, structures  # noqa: F401 - they register their queries
