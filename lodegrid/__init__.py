"""Evidence analytics as composable DataFrame to DataFrame functions on Spark."""
