"""Errors of media handling."""


class MediaError(Exception):
    pass


class BinaryNotFound(MediaError):
    pass


class BinaryCallFailed(MediaError):
    pass


class InvalidMedia(MediaError):
    pass


class StreamIndexOutOfBound(MediaError):
    pass


class StreamEntryNotFound(MediaError):
    pass


class StreamLoadError(MediaError):
    pass
