"""What the data can and cannot say about a contract before a person confirms it."""
