"""Registered queries of the panel operators."""

from panelia.plans import accounting, audit, cross, decisions, execution, inference, joins, labels, ledgers, legs, models, reconcile, refits, scans, setups, splits, streams, trades, windows  # noqa: F401
from panelia.plans.accounting import flagship  # noqa: F401
from panelia.plans.registry import QUERIES, SQL  # noqa: F401
