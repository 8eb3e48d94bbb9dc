"""functions of stratalens."""
