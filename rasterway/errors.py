"""Errors and warnings; each error is also the built-in that it specialises."""


class RasterwayError(Exception):
    """Base of all errors raised here."""


class ConfigError(RasterwayError, ValueError):
    """A definition is incomplete or contradicts itself."""


class LayerExistsError(RasterwayError, FileExistsError):
    """A layer or store exists and may not be overwritten."""


class MissingLayerError(RasterwayError, KeyError):
    """A layer or column is not there."""


class MissingFileError(RasterwayError, FileNotFoundError):
    """A store, table or file is not there."""


class ProfileError(RasterwayError, ValueError):
    """Two grids differ in shape, reference system or transform."""


class PathNotFoundError(RasterwayError, RuntimeError):
    """No route joins a start with any end."""


class UnsupportedError(RasterwayError, NotImplementedError):
    """Asked for something that needs an extension."""


class RasterwayWarning(UserWarning):
    """Base of all warnings issued here."""


class DeprecatedWarning(RasterwayWarning, DeprecationWarning):
    """A name that still works but will go."""
