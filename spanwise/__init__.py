"""Person-time analytics on Spark: follow-up periods, densities and incidence."""
