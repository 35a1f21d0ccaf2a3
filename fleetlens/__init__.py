"""Fleet catalog analytics and maintenance on Spark."""
