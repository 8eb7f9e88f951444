"""Programs over micro-batches."""
