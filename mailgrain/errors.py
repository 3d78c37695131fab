"""What can go wrong, by kind; every error of the package is a MailError."""

from __future__ import annotations


class MailError(Exception):
    """Base of all errors of this package."""


class ToolMissing(MailError):
    """An external program isn't there."""


class ParseError(MailError):
    """A message can't be read."""


class SourceError(MailError, RuntimeError):
    """A source that isn't what it should be."""


class ConfigError(MailError, ValueError):
    """A rule file or account setting that can't be used."""


class RenderError(MailError):
    """A page can't be rendered."""


class ArchiveFormatError(MailError):
    """A document can't be made fit for archiving."""


class ImageError(MailError):
    """A picture can't be converted."""


class EncryptedError(MailError, PermissionError):
    """A document is locked."""


class DamagedError(MailError, ValueError):
    """A document is damaged."""


class MergeError(MailError):
    """Documents can't be joined."""


class ValidationError(MailError):
    """A validator gave no usable report."""
