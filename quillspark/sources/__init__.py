"""Sources and sinks: tables, files, feeds and landed JSON; fetching itself is left to adapters."""
