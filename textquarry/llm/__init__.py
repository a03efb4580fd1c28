"""Operators for preparing language-model training text at corpus scale.

Nothing outside this folder (and the driver contract file, which tolerates its
absence) imports it.
"""
