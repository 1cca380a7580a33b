"""seasonloom: workload and injury cohort analytics as Spark DataFrame jobs."""
