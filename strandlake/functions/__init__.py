"""Column functions: alphabets, hashing, sampling and packing."""
