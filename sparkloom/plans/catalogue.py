"""All registries of the core."""

from __future__ import annotations

from sparkloom.plans import engine, landing, mechanisms, ranks, relational, reports

REGISTRIES = [landing.R, relational.R, ranks.R, engine.R, mechanisms.R, reports.R]
