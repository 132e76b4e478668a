"""Part of webloom."""
