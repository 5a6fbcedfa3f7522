"""Document and wide-column analytics as Spark plans."""
