"""Column-level helpers (JVM-side expressions only; no Python UDFs)."""

from cohortlens.functions.timefn import hours_between, days_between, add_hours  # noqa: F401
from cohortlens.functions.nulls import normalize_na, NA_TOKENS  # noqa: F401
