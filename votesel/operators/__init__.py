"""DataFrame operators of the selection engine (one module per concern)."""
