"""Nothing yet: the dialect has no streams, tasks or pipes."""
