"""The query language: lexer, postfix form, and its compilation to one Boolean Column."""
