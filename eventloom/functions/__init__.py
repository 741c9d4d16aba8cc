"""Column functions: no DataFrame, no action, no Python in the data path unless a module says so."""
