"""Analytics on vector collections and keyed command logs, written as Spark plans."""
