"""Column functions: URLs, local paths, style sheets, categories, validation."""
