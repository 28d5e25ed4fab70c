"""Transaction analytics and profiling, expressed as Spark DataFrame plans."""
