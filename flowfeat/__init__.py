"""flowfeat: field-observation, time-series and corpus operators as Spark DataFrame transforms."""
