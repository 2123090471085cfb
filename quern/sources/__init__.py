"""Where namespaces come from: existing tables, and the log of facts."""
