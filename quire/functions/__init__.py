"""Column functions over citation text."""
