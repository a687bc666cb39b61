"""DataFrame-to-DataFrame operators: no globals, no collect, no actions."""
