"""Column functions and small numeric rules that operators share."""
