"""Tables in, panels out."""
