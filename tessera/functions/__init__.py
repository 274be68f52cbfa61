"""Column functions and byte codecs."""
