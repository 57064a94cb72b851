"""Filter constructors and scalar helpers."""
