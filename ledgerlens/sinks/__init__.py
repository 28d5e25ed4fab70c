"""ledgerlens.sinks."""
