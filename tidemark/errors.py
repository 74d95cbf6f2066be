"""Errors of the engine."""


class EngineError(Exception):
    """Any failure of the engine."""


class IoError(EngineError):
    """A file or folder can't be read or written."""


class SerializationError(EngineError):
    """A stored text is not of the form it should have."""


class StoreError(EngineError):
    """A persisted table is missing or does not fit."""


class ConfigError(EngineError):
    """A setting names nothing that there is."""


class ModelError(EngineError):
    """A signature can't be made."""


class SecurityError(EngineError):
    """An action would touch a file that has to stay."""


class PluginError(EngineError):
    """An extension failed."""

    def __init__(self, plugin: str, message: str):
        super().__init__(f"{plugin}: {message}")
        self.plugin, self.message = plugin, message
