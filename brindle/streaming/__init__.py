"""Tables that are kept up to date from files as they arrive."""
