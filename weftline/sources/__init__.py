"""Files: scans, sinks, and the guessing of a file's columns."""
