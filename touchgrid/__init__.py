"""touchgrid: match-tracking analytics on PySpark."""
