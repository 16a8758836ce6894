"""DataFrame -> DataFrame operators. None collects, and none holds a session."""
