"""Column functions: token features and their compiler."""
