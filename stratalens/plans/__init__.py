"""plans of stratalens."""
