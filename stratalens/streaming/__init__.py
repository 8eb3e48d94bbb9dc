"""streaming of stratalens."""
