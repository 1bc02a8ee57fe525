"""Plant-topology analytics on Spark: typed tables in, typed tables out."""
