"""Event, claim and policy panel analytics as Spark DataFrame jobs."""
