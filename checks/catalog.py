"""All registered queries."""

from __future__ import annotations

from checks import extracts, linking, model, reports, texts  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
