"""Regridding of microwave-radiometer swaths as Spark DataFrame operations."""
