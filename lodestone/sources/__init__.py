"""Tables, listings, suites and result sinks."""
