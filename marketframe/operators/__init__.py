"""DataFrame -> DataFrame operators over the long (symbol, date) table."""
