"""Every query of the library over the test tables, with SQL to check each result."""
