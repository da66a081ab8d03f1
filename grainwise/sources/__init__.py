"""Loading delimited files with every loss counted, and reading landed files for their layout."""
