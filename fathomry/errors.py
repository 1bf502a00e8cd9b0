"""Errors with a stable code, an exit code and a hint."""


class EngineError(Exception):
    code, exit_code = "error", 1

    def __init__(self, message: str, hint: str = ""):
        super().__init__(f"{message} ({hint})" if hint else message)
        self.hint = hint


class UsageError(EngineError):
    code, exit_code = "usage", 2


class UnknownFormat(EngineError):
    code, exit_code = "unknown_format", 3


class CorruptInput(EngineError):
    code, exit_code = "corrupt", 4


class Unsupported(EngineError):
    code, exit_code = "unsupported", 6
