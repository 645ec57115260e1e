"""Evidence analytics as DataFrame operators on Spark."""
