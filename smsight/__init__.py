"""Messaging analytics on Spark: DataFrame-to-DataFrame operators for bulk-SMS data."""
