"""Training-data operators over text. Nothing outside this subpackage imports it."""
