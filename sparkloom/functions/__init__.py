"""Column functions: parsing, rendering, comparing and inferring from text."""
