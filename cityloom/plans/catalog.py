"""All registered queries."""

from cityloom.plans import cells, energy, joins, labels, model, sampling, scans, shapes  # noqa: F401
from cityloom.plans.registry import ORACLES, QUERIES  # noqa: F401
