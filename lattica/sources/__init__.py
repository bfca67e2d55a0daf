"""Where graphs come from: projects on disk, their sources, stored graphs and reports."""
