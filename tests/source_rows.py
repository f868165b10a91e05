"""The columns of hand-made source files."""

SOURCE = "project string, module_path string, rel_path string, file_path string, content string"
