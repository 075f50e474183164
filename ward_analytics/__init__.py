"""Ward analytics: bedside vital signs scored, served and explained with Spark."""
