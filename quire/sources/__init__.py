"""Sources and sinks of document relations."""
