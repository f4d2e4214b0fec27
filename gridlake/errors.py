"""Typed errors with a coarse code."""


class GridlakeError(Exception):
    code = "internal"


class AuthoringError(GridlakeError):
    code = "authoring"


class MalformedInput(GridlakeError):
    code = "malformed-input"


class UnsupportedFormat(GridlakeError):
    code = "unsupported-format"
