"""Knowledge-base analytics as DataFrame operators on Spark."""
