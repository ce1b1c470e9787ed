"""functions of quillstack."""
