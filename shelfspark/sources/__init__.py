"""Where tables and requests come from, and where tables go."""
