"""Speech-corpus construction, sampling and evaluation as Spark DataFrame operators."""
