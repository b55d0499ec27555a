"""Column functions of the content filter, and the few that need a line-by-line pass in Python."""
