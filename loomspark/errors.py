"""Errors of the engine: configuration, stages (transient, fatal, parser, validation), repositories and sources."""


class EngineError(Exception):
    """Base of all."""


class ConfigurationError(EngineError):
    pass


class StageError(EngineError):
    pass


class TransientStageError(StageError):
    """May succeed if tried again."""


class FatalStageError(StageError):
    pass


class ParserError(StageError):
    pass


class ValidationError(StageError):
    pass


class RepositoryError(EngineError):
    pass


class SourceError(EngineError):
    pass
