"""Question planner: text to a frozen specification to one DataFrame."""
