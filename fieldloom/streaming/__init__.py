"""Nothing here: the domain has no streams; chains of configurations are checkpointed batch loops."""
