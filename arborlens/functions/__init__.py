"""Column expressions: paths, globs, text and token counts."""
