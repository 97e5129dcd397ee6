"""Column functions: text, values, dates, scores. Built-in expressions, so they stay in generated code."""
