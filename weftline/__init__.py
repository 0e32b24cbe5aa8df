"""Analytics over entity graphs, versioned facts, text collections and event streams on Spark."""
