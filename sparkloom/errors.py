"""Errors of the library, all below one base."""


class LoomError(Exception):
    """Anything the library reports on purpose."""


class SourceError(LoomError):
    """Input files that can't be read as what they should be."""


class ConfigError(LoomError):
    """A configuration outside the closed grammar."""


class PlanError(LoomError):
    """A plan whose shapes, names or parameters don't fit together."""


class ConversionError(LoomError):
    """A conversion that can't finish."""


class VerifyError(LoomError):
    """A verification that can't be carried out."""
