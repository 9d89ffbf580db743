"""Column-to-Column expressions: narrow, no shuffle."""
