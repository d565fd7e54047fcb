"""Table-shaped queries over the test tables, each with its SQL twin."""
