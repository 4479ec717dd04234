"""Row numbering, slices, quantities, measures and images."""
