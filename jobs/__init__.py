"""Runnable jobs: each module has a function that takes a session and plain paths, and a command line."""
