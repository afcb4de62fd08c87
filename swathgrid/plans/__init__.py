"""Whole runs: configuration, regridding from samples to product, and the product on disk."""
