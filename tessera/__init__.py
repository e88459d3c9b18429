"""Spark-first record resolution, case analytics and SQL question pack."""
