"""Tables, shared scratch space and the on-disk store."""
