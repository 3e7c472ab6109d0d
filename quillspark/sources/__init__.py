"""Readers and writers: note files, JSON lines, snapshots, event log."""
