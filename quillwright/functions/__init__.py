"""Column functions and decoders."""
