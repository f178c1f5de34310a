"""tidewell: activity-log and note-corpus analytics on PySpark."""
