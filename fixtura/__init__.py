"""fixtura: two-sided contest analytics expressed as Spark DataFrame jobs."""
