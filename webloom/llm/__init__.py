"""Training-data operators; nothing else in webloom imports this subpackage."""
