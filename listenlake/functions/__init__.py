"""Column functions; none of them needs a Python UDF."""
