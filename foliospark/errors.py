"""Errors of the engine. On executors, parsers put the message into an `error` column instead of failing the job."""


class FolioError(Exception):
    """Base of all errors here."""


class UnsupportedFormatError(FolioError):
    """No parser takes the file."""


class ParseError(FolioError):
    """A file can't be parsed."""


class SizeLimitError(FolioError):
    """A file is larger than allowed."""


class ArchiveReadError(FolioError):
    """An archive is incomplete or of another version."""


class ArchiveWriteError(FolioError):
    """An archive can't be written."""


class IntelligenceError(FolioError):
    """A language-model call failed."""


class ConnectorError(FolioError):
    """A source can't be reached."""


class EmbedError(FolioError):
    """An embedding call failed."""


class QuantizationError(FolioError):
    """An unknown quantisation mode, or bytes that don't fit it."""
