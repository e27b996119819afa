"""Column functions: built-in expressions first, Arrow functions where none exist."""
