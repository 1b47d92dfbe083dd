"""Part of lexloom; see README.md."""
