"""Operators that prepare training corpora for language models; nothing else in the library imports this."""
