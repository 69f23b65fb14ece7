"""Reading and writing tickets, splits and results."""
