"""Part of the stowage package."""
