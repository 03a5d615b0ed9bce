"""Column functions with the semantics of array arithmetic."""
