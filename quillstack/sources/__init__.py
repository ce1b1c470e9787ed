"""sources of quillstack."""
