"""Reading and writing tables, polygon layers and map files."""
