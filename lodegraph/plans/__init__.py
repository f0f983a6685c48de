"""Named queries over the project's tables, with their SQL twins."""
