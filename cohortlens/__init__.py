"""cohortlens: cohort building and order-pattern analytics expressed as Spark plans.

Every public operator is a function from DataFrames to a DataFrame.  Nothing
data-sized is collected to the driver; only fixed-size results (model
centres, test statistics) ever leave the executors.
"""

from cohortlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
