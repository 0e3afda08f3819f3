"""gaitworks: robot-trajectory analytics written as Spark DataFrame jobs."""
