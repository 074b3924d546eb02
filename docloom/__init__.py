"""docloom: denormalised document views, kept in step with their tables, on PySpark."""
