"""Sources and sinks: typed readers, writers, stand-in views over the test tables."""
