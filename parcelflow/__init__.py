"""parcelflow: located property records from raw files to an evaluated model, as Spark jobs."""
