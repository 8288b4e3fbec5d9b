"""spendweave: cloud-bill variance analytics written as Spark DataFrame jobs."""
