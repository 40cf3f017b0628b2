"""``DataFrame -> DataFrame`` operators, usable through ``DataFrame.transform``."""
