"""Column functions; the geometric ones work on numpy arrays as well."""
