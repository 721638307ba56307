"""Column functions: text, dates, supply arithmetic."""
