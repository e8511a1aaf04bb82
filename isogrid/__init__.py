"""Climate-grid jobs on Spark: batch and streaming operators over gridded monthly observations."""
