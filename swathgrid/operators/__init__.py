"""Joins, reductions, reconstructions and scores over samples, targets and neighbours."""
