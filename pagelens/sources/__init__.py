"""Readers of snapshots and files; sinks of sites, metadata and state."""
