"""Column functions: text, JSON payloads and nested records."""
