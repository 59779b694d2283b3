"""Tables, message files and shared storage."""
