"""Training-data operators. Optional: nothing else in the library imports this subpackage."""
