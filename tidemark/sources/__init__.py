"""Where tables come from and go: the versioned store, connections, exports."""
