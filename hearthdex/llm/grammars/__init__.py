"""Bundled grammars as text files, read by hearthdex.llm.parsing."""
