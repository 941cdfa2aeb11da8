"""Operators for preparing training text; nothing else in gridspark imports this subpackage."""
