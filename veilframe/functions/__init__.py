"""Column functions: they build lazy Spark columns, so that Catalyst sees and optimises the whole plan."""
