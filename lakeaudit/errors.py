"""Errors of the engine; all are ValueErrors."""


class AuditError(ValueError):
    """Base of all errors here."""


class PolicyError(AuditError):
    """A policy file or table is malformed."""


class TraceError(AuditError):
    """A trace row is malformed."""


class MappingError(AuditError):
    """A mapping is malformed, or a row does not fit it."""


class ConfigError(AuditError):
    """A project configuration is malformed."""


class ConfigNotFound(ConfigError, FileNotFoundError):
    """No project configuration was found."""
