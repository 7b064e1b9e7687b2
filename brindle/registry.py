"""The registered queries of the relational engine."""

from __future__ import annotations

import brindle.plans.sessions  # noqa: F401  registers its queries
from brindle.plans.catalogue import ORACLES, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["flagship"](spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]
