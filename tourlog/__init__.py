"""tourlog: daily field-report analytics expressed as Spark DataFrame jobs."""
