"""Readers of binary formats, after their published specifications.  Damaged input yields less, or a DamagedFile, never more."""
