"""Entity graph operators."""
