"""From a statement's text to a DataFrame: lexer, parser, binder, planner."""
