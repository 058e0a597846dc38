"""Registered queries. Importing this package registers every plan module."""

from roamlens.plans.registry import REGISTRY  # noqa: F401
from roamlens.plans import reports, extraction, textmining, matching, learning, streams, models  # noqa: F401


def queries():
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql():
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
