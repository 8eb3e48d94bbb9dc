"""sources of stratalens."""
