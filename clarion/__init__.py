"""clarion: claim-evidence analytics and training-data operators as Spark jobs."""
