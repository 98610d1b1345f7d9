"""rolesift: job-posting analytics as PySpark DataFrame and streaming jobs."""
