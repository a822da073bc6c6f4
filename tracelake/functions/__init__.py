"""See README.md for the operator inventory."""
