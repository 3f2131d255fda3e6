"""The small languages: predicates, arithmetic, sort orders, and their compilation to Spark expressions."""
