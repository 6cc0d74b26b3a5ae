"""What can go wrong with record files and messages."""


class RecordFileError(Exception):
    """Any failure of a record file."""


class MalformedData(RecordFileError):
    """The bytes break the format."""


class HashMismatch(MalformedData):
    """Bytes differ from their stored hash."""


class UnsupportedCompression(RecordFileError):
    """The codec is not installed."""


class UnknownCompression(RecordFileError):
    """No codec has this byte."""


class UnknownChunkType(MalformedData):
    """A chunk with records is of no known type."""


class WriterClosed(RecordFileError):
    """Writing after the end."""


class WriterFailed(RecordFileError):
    """Writing after a failure."""


class MessageError(RecordFileError):
    """A record is no message where one is needed; ``index`` is its place, if known."""

    def __init__(self, what: str, index: int | None = None):
        super().__init__(what if index is None else f"record {index}: {what}")
        self.index = index
