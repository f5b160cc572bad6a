"""Jobs that are run from a command line: ``python -m jobs.intake`` and ``python -m jobs.evaluate``."""
