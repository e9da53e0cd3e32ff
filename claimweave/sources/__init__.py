"""Ways in and out of a claim graph."""
