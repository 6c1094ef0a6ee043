"""Query catalogue: named Spark plans over the driver's tables and their SQL oracles."""
