"""gatewarden — fleet-operations analytics for supervised agent gateways, on Spark.

DataFrame-in, DataFrame-out jobs over a fleet's settings snapshots, logs,
lifecycle events, pairing history and access logs.  See README.md.
"""

__version__ = "0.1.0"
