"""Spark jobs for threaded online discussions: clean, thread, mine, label, search, serve."""
