"""The analysis over patches that keep arriving."""
