"""Processing plans: architecture strings, recipes from options, and the command line."""
