"""Notegrove: PySpark-native analytics over Markdown knowledge bases."""

__all__ = ["SavedVault", "VaultEngine"]


def __getattr__(name: str):
    """The entry points, imported when asked for: Python workers import this package too."""
    if name == "VaultEngine":
        from .engine import VaultEngine

        return VaultEngine
    if name == "SavedVault":
        from .index import SavedVault

        return SavedVault
    raise AttributeError(name)
