"""Movement, patrol and field-event analytics as Spark DataFrame jobs."""
