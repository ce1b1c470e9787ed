"""sinks of quillstack."""
