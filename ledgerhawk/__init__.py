"""ledgerhawk — transaction-risk analytics on Spark.

Plain ``DataFrame -> DataFrame`` functions over transactions, bookings,
agencies and application logs: cleaning, account / sequence / IP
features, rule scorers, a calibrated decision, an ordered credit fold,
account-graph measures, model fit / evaluation and streaming twins.
"""

__version__ = "0.1.0"
