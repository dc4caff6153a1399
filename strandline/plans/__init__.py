"""Plan builders (range join, sweeps) and the registered query suite."""
