"""The job plane: events as streams, and the state of jobs."""
