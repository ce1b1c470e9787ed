"""operators of quillstack."""
