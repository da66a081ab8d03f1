"""What a table holds, before anyone says what it means."""
