"""Nearest-neighbour decision analytics on PySpark, with a corpus-preparation subpackage."""
