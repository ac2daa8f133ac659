"""Named queries over the given tables, each with an ANSI SQL counterpart."""
