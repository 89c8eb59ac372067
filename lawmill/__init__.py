"""lawmill: legislative-activity analytics as lazy Spark DataFrame functions."""
