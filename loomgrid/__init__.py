"""loomgrid: hybrid retrieval and corpus preparation as PySpark DataFrame programs."""
