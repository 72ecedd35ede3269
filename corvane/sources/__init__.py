"""Reading the tables the engine works on, and parsing files."""
