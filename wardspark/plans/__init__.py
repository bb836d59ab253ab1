"""Query catalog (Spark builders + DuckDB oracle texts) and stage-level plans."""
