"""Programs inside transcripts: shell, Python and JavaScript text to the files that they use."""
