"""Importing this module registers every check."""

from checks import evaluation, learning, live, luck, scalars, windows  # noqa: F401
