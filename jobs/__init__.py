"""Jobs that run by themselves: each module is a function over a session and a command line."""
