"""Actions, recipes and their plans."""
