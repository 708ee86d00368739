"""The SQL dialect: lexer, parser, checker, estimates and lowering; and the registry of queries."""
