"""Recipes and the registered queries over the driver's tables."""
