"""ledgerloom: document enrichment and agreement analytics as Spark plans."""
