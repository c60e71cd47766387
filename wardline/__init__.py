"""Clinical-timeline analytics as Spark jobs: cohorts, features, labels, models, checks."""
