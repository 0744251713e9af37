"""Sources and sinks: table scans, the test-table binding, findings I/O."""
