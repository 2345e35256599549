"""Exceptions of the engine."""

from __future__ import annotations


class EngineError(Exception):
    """Root of the engine's own exceptions."""


class DependencyError(EngineError, ImportError):
    """An optional package is asked for and not installed."""


class DataValidationError(EngineError, ValueError):
    """Data and request don't go together, as a mean of text."""


class DataTypeConversionError(DataValidationError):
    """A value has no equal in the type asked for."""


class SchemaValidationError(EngineError, ValueError):
    """A contract can't be meant as it is written."""


class EncodingError(EngineError, ValueError):
    """Text that core repair can't mend is left."""


class SerializationError(EngineError):
    """A plan can't be written."""


class DeserializationError(SerializationError):
    """A plan can't be read back."""


class RegistryError(EngineError, ValueError):
    """A name is taken or unknown."""
