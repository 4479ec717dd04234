"""Tables on disk and other formats."""
