"""Web-page mining and text analytics as PySpark DataFrame jobs."""
