"""Column functions: no shuffle, no Python in the row path unless said so."""
