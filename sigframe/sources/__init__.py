"""Sources, sinks and caches of signal frames."""
