"""spendwatch: usage-cost and usage-anomaly analytics as Spark DataFrame jobs.

Every job takes DataFrames and parameters and returns a DataFrame; nothing is
collected to the driver except single scalars used for run-time checks.
"""

__version__ = "0.1.0"
