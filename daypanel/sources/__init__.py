"""Reading and writing panels, and the panel derived from the test tables."""
