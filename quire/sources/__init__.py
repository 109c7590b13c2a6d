"""Sources and sinks: pages, tables, web pages, profiles, question sets, reports, caches, the chunk index."""
