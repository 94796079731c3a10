"""Reference results in plain SQL, written apart from the Spark code."""
