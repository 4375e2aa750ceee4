"""Column functions: text, scoring rules, prompt text and fixed values."""
