"""Column functions and the small languages (patterns, globs, file types) that compile to them."""
