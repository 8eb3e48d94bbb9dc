"""operators of stratalens."""
