"""Column functions: text, versions, hashing, references."""
