"""Following a project's audit files as they change."""
