"""Column functions: hash randomness, guarded statistics, special functions, prefix sums."""
