"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""
from roamlens.functions.columns import *  # noqa: F401,F403
