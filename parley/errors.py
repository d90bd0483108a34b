"""Errors of the library. Only the command line turns them into an exit status."""


class ParleyError(Exception):
    """The base of all."""


class SettingsError(ParleyError):
    """A required setting is missing or empty."""


class DocumentError(ParleyError):
    """A document can't be read."""


class DocumentNotFound(DocumentError):
    """There is no such document."""
