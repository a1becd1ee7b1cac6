"""Jobs built from the operators: report, sinks, and the queries on the driver tables."""
